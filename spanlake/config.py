"""Detection options, as values in the plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    min_confidence: float = 0.5
    context_boost: float = 0.15
    context_window: int = 5
    ner_enabled: bool = False
    code_mode: str = "off"  # off, secrets or full
    public_domains: tuple[str, ...] = ()
    regex_enabled: bool = True

    @classmethod
    def from_json(cls, text: str | None) -> Config:
        """Fields that are absent, null or of a wrong type keep their defaults; so does
        everything if the text is empty or no JSON object."""
        try:
            given = json.loads(text or "")
        except ValueError:
            return cls()
        if not isinstance(given, dict):
            return cls()
        base, own = cls(), {}
        for f in fields(cls):
            v, like = given.get(f.name), getattr(base, f.name)
            if f.name == "public_domains":
                if isinstance(v, list) and all(isinstance(x, str) for x in v):
                    own[f.name] = tuple(v)
            elif f.name == "code_mode":
                if v in ("off", "secrets", "full"):
                    own[f.name] = v
            elif isinstance(like, bool):
                if isinstance(v, bool):
                    own[f.name] = v
            elif isinstance(v, (int, float)) and not isinstance(v, bool):
                own[f.name] = type(like)(v)
        return replace(base, **own)


CONFIG_DDL = "min_confidence double, context_boost double, context_window int, ner_enabled boolean, code_mode string, public_domains array<string>, regex_enabled boolean"


def parsed_config(text: Column) -> Column:
    """The same for a column of JSON texts: a struct without nulls."""
    given = F.from_json(text, CONFIG_DDL)
    d = Config()
    mode = F.when(given["code_mode"].isin("off", "secrets", "full"), given["code_mode"]).otherwise(d.code_mode)
    plain = ("min_confidence", "context_boost", "context_window", "ner_enabled", "regex_enabled")
    return F.struct(
        *(F.coalesce(given[f], F.lit(getattr(d, f))).alias(f) for f in plain),
        mode.alias("code_mode"),
        F.coalesce(given["public_domains"], F.array().cast("array<string>")).alias("public_domains"),
    )
