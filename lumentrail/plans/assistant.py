"""Intents of assistant phrases, compound plans and references to earlier results."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Rules in order; the first that matches wins. What removes stands before what adds, and words are whole.
RULES: tuple[tuple[str, str], ...] = (
    ("remove_favorites", r"\b(?:unfavou?rite|unlike|remove (?:these|those|them|it) from favou?rites)\b"),
    ("add_favorites", r"\b(?:favou?rite|like) (?:these|those|them|this|it|all)\b|\badd (?:these|those|them|it) to favou?rites\b"),
    ("restore", r"\b(?:restore|untrash|undelete)\b"),
    ("unhide", r"\bunhide\b"),
    ("hide", r"\bhide\b"),
    ("archive", r"\barchive\b"),
    ("delete", r"\b(?:delete|trash|remove)\b"),
    ("create_album", r"\b(?:create|make|new) (?:an? )?(?:album|collection)\b"),
    ("duplicates", r"\b(?:duplicates?|copies|identical)\b"),
    ("blurry", r"\b(?:blurry|out of focus)\b"),
    ("screenshots", r"\bscreenshots?\b"),
    ("storage", r"\b(?:storage|disk|space|how (?:big|large))\b"),
    ("count", r"\b(?:how many|count|number of)\b"),
    ("best", r"\bbest\b"),
    ("people_stats", r"\b(?:who (?:appears|is)|most (?:photographed|frequent) (?:person|people))\b"),
    ("place_stats", r"\b(?:where (?:have|did|was)|places? (?:i|we))\b"),
    ("timeline", r"\b(?:timeline|over time|per (?:month|year))\b"),
    ("trips", r"\b(?:trips?|vacations?|travels?)\b"),
    ("memories", r"\b(?:memor(?:y|ies)|on this day)\b"),
    ("events", r"\bevents?\b"),
    ("videos", r"\bvideos?\b"),
    ("favorites", r"\b(?:favou?rites?|liked)\b"),
    ("similar", r"\b(?:similar|like this|more like)\b"),
    ("overview", r"\b(?:overview|summary|statistics|stats)\b"),
    ("help", r"\b(?:help|what can you)\b"),
)
ACTION_WORDS = re.compile(r"\b(?:find|show|delete|remove|create|make|add|favou?rite|archive|hide|share|count|search)\b", re.I)
REFERENCES = re.compile(r"\b(?:those|them|these|they|last results?|previous results?|that result)\b", re.I)
DESTRUCTIVE = frozenset(("delete", "hide", "archive", "remove_favorites"))


def intent(text: str) -> str:
    """The intent of a phrase; ``search`` where no rule holds."""
    return next((name for name, rule in RULES if re.search(rule, text, re.I)), "search")


def steps(text: str) -> list[str]:
    """A compound phrase as its steps, if more than one part names an action."""
    parts = [p.strip() for p in re.split(r"\s*(?:,\s*)?\b(?:and then|then|and|also|after that|next)\b\s*", text, flags=re.I) if p.strip()]
    return parts if len(parts) > 1 and all(ACTION_WORDS.search(p) for p in parts[1:]) else [text.strip()]


def refers_back(text: str) -> bool:
    return bool(REFERENCES.search(text))


def allowed(action: str, n: int, *, most: int = 500, most_destructive: int = 50) -> bool:
    """Whether a batch of ``n`` items may be acted on at once."""
    return 0 < n <= (most_destructive if action in DESTRUCTIVE else most)


@dataclass
class ResultSets:
    """Results by id for a while; times are seconds that the caller gives."""

    ttl: float = 1800.0
    kept: dict[str, tuple[float, DataFrame]] = field(default_factory=dict)

    def put(self, name: str, df: DataFrame, now: float) -> None:
        self.evict(now)
        self.kept[name] = (now, df)

    def latest(self, now: float) -> DataFrame | None:
        """The newest result that is still alive."""
        self.evict(now)
        return max(self.kept.items(), key=lambda kv: (kv[1][0], kv[0]))[1][1] if self.kept else None

    def evict(self, now: float) -> None:
        self.kept = {k: v for k, v in self.kept.items() if now - v[0] <= self.ttl}


def answered(name: str, operators: dict, *args, fallback: str = "search") -> DataFrame:
    """The DataFrame of an intent from a table of operators."""
    return operators.get(name, operators[fallback])(*args)


def registered(tools: Sequence[tuple[str, frozenset[str]]], permission: str) -> list[str]:
    """Names of the tools that a permission allows."""
    return sorted(n for n, needs in tools if permission in needs or not needs)
