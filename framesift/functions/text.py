"""Contrast edits of a word list."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from framesift.functions.hashing import stable_int

# Meaning swaps and number words.
SWAPS = {
    "có": "không", "không": "có", "được": "bị", "bị": "được", "tăng": "giảm", "giảm": "tăng",
    "đúng": "sai", "sai": "đúng", "nhiều": "ít", "ít": "nhiều", "trước": "sau", "sau": "trước",
    "lớn": "nhỏ", "nhỏ": "lớn", "cao": "thấp", "thấp": "cao", "nên": "không nên", "đã": "chưa",
    "chưa": "đã", "đồng ý": "phản đối", "thắng": "thua", "thua": "thắng", "mua": "bán", "bán": "mua",
}
NUMBERS = ["một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín", "mười", "trăm", "nghìn"]
SHIFTS = [-3, -2, -1, 1, 2, 3, 5, 10]


def clean_words(text: Column) -> Column:
    return F.transform(F.split(text, " "), lambda w: F.regexp_replace(F.lower(w), r"[^\wÀ-ỹ]", ""))


def edit_words(words: Column, ident: Column, seed: str, swaps: dict[str, str] | None = None,
               numbers: list[str] | None = None) -> Column:
    """struct(text, kind): first swap of the dictionary (longest source first), else the first
    number changed by a hashed step, else NULLs."""
    swaps, numbers = swaps or SWAPS, numbers or NUMBERS
    joined = F.array_join(words, " ")
    text, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    h = stable_int(F.concat(F.lit(f"{seed}:"), ident.cast("string")))
    names = F.array(*[F.lit(n) for n in numbers])
    is_number = F.transform(words, lambda w: w.rlike("^[0-9]{1,15}\\z") | F.array_contains(names, w))
    at = F.array_position(is_number, True).cast("int")
    word = F.get(words, at - 1)
    steps = F.array(*[F.lit(s) for s in SHIFTS])
    digits = F.abs(word.try_cast("bigint") + F.get(steps, (h % len(SHIFTS)).cast("int"))).cast("string")
    place = F.array_position(names, word).cast("int") - 1
    other = F.get(names, ((place + 1 + h % (len(numbers) - 1)) % len(numbers)).cast("int"))
    changed = F.coalesce(digits, other)
    edited = F.concat_ws(" ", F.slice(words, 1, F.greatest(at - 1, F.lit(0))), F.array(changed),
                         F.slice(words, F.greatest(at + 1, F.lit(1)), F.size(words)))
    text, kind = F.when(at > 0, edited), F.when(at > 0, F.lit("number"))
    for src in sorted(swaps, key=len):
        hit = joined.rlike(rf"(^| ){re.escape(src)}( |\z)")
        first = F.regexp_replace(joined, rf"(?s)^(.*?(?:^| )){re.escape(src)}((?: |\z).*)\z", f"$1{swaps[src]}$2")
        text = F.when(hit, first).otherwise(text)
        kind = F.when(hit, F.lit(f"swap:{src}->{swaps[src]}")).otherwise(kind)
    return F.struct(text.alias("text"), kind.alias("kind"))
