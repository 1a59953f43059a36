"""Field classification and masks as column expressions."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from enum import IntEnum
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SensitivityError(ValueError):
    pass


class Level(IntEnum):
    PUBLIC = 0
    INTERNAL = 1
    CONFIDENTIAL = 2
    RESTRICTED = 3


# Names of levels, and parts of field names by level and by mask.
ALIASES = {
    "public": Level.PUBLIC, "公开": Level.PUBLIC, "internal": Level.INTERNAL, "内部": Level.INTERNAL,
    "confidential": Level.CONFIDENTIAL, "机密": Level.CONFIDENTIAL, "restricted": Level.RESTRICTED, "受限": Level.RESTRICTED,
}
RESTRICTED_WORDS = (
    "password", "passwd", "secret", "token", "api_key", "apikey", "access_key",
    "身份证", "证件号", "身份证号", "id_card", "银行卡", "卡号", "bank_account", "bankcard",
)
CONFIDENTIAL_WORDS = (
    "email", "e_mail", "邮箱", "phone", "mobile", "手机号", "电话", "姓名", "name",
    "address", "地址", "住址", "生日", "birth", "ip", "device_id", "设备号",
)
PUBLIC_WORDS = ("count", "ratio", "rate", "status", "created_at", "date", "日期", "时间")
MASK_WORDS = {
    "email": ("email", "e_mail", "邮箱"), "phone": ("phone", "mobile", "手机号", "电话"), "id_card": ("身份证", "证件", "id_card"),
    "name": ("name", "姓名"), "address": ("address", "地址", "住址"),
}


def parse_level(value) -> Level:
    """A level, its number, L0 to L3, or its name in English or Chinese."""
    if isinstance(value, str):
        word = value.strip().lower()
        if word in ALIASES:
            return ALIASES[word]
        value = int(word[1]) if len(word) == 2 and word[0] == "l" and word[1].isdigit() else None
    if isinstance(value, bool) or not isinstance(value, int) or value not in set(Level):
        raise SensitivityError(f"not a sensitivity level: {value!r}")
    return Level(value)


def classify(name: str, declared=None) -> tuple[Level, str, str]:
    """(level, reason, mask) of a field: a declared level wins over its name."""
    key = name.strip().lower() if isinstance(name, str) else ""
    if not key:
        raise SensitivityError("a field needs a name")
    rules = [(Level.RESTRICTED, RESTRICTED_WORDS), (Level.CONFIDENTIAL, CONFIDENTIAL_WORDS), (Level.PUBLIC, PUBLIC_WORDS)]
    if declared is not None:
        level, reason = parse_level(declared), "declared"
    else:
        hit = next((r for r, words in rules if any(w in key for w in words)), None)
        level, reason = (Level.INTERNAL, "unknown") if hit is None else (hit, "name")
    if level == Level.RESTRICTED:
        return level, reason, "redact"
    mask = next((m for m, words in MASK_WORDS.items() if any(w in key for w in words)), None)
    return level, reason, mask or ("tokenize" if level >= Level.CONFIDENTIAL else "none")


def load_policy(path: str | Path) -> dict[str, Level]:
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(raw, dict) or raw.get("schema_version") != 1 or not isinstance(raw.get("fields"), dict):
        raise SensitivityError("a policy has schema_version 1 and an object of fields")
    return {k: parse_level(v) for k, v in raw["fields"].items()}


def token(value: Column, salt: str) -> Column:
    if not salt:
        raise SensitivityError("tokens need a salt")
    return F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), value.cast("string")), 256), 1, 12))


def mask(value: Column, level: Level, kind: str, reveal: Level = Level.INTERNAL, salt: str = "tallywell") -> Column:
    """The value as a viewer of level ``reveal`` sees it; null stays null."""
    if level <= reveal:
        return value
    text, n = value.cast("string"), F.length(value.cast("string"))
    hidden = token(value, salt) if level == Level.RESTRICTED else F.lit("***")
    shown = {
        "email": F.when(text.contains("@"), F.concat(
            F.when(text.startswith("@"), "*").otherwise(F.substring(text, 1, 1)), F.lit("***@"),
            F.substring(text, F.instr(text, "@") + 1, n))),
        "phone": F.when(F.length(F.regexp_replace(text, "[^0-9]", "")) >= 4, F.concat(
            F.lit("***"), F.right(F.regexp_replace(text, "[^0-9]", ""), F.lit(4)))),
        "id_card": F.when(n >= 4, F.concat(F.substring(text, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(text, F.lit(2)))),
        "name": F.when(n > 0, F.concat(F.substring(text, 1, 1), F.repeat(F.lit("*"), F.greatest(n - 1, F.lit(1))))).otherwise("*"),
        "address": F.when(n > 2, F.concat(F.substring(text, 1, 2), F.lit("***"))),
    }
    if kind == "tokenize":
        hidden = token(value, salt)
    out = F.coalesce(shown[kind], hidden) if kind in shown else hidden
    return F.when(value.isNotNull(), out)


def redact(df: DataFrame, policy: Mapping[str, object] | None = None, reveal: Level | str | int = Level.INTERNAL, salt: str = "tallywell") -> DataFrame:
    """Every column as a viewer of level ``reveal`` sees it."""
    reveal, policy = parse_level(reveal), policy or {}
    out = []
    for c in df.columns:
        level, _, kind = classify(c, policy.get(c))
        out.append(mask(F.col(f"`{c}`"), level, kind, reveal, salt).alias(c))
    return df.select(*out)


def classify_columns(names: Iterable[str], policy: Mapping[str, object] | None = None) -> dict[str, dict]:
    names = list(names)
    if len(set(names)) < len(names):
        raise SensitivityError("a field occurs twice")
    found = {n: classify(n, (policy or {}).get(n)) for n in names}
    return {n: {"level": v[0].name.lower(), "reason": v[1], "strategy": v[2]} for n, v in found.items()}
