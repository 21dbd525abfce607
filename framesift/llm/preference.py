"""Preference formatting: the longest common turn prefix once as prompt, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.tables import read

TRAINED = "assistant"  # turns of this role are learned; the rest of a completion is masked


def opened(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def rendered(turn: Column) -> Column:
    """One turn as text; marks inside the text cannot be taken for the template's own."""
    return F.concat(opened(turn["role"]), turn["text"], F.lit("<|end|>\n"))


def text_of(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def trained_spans(turns: Column) -> Column:
    """Code points of a completion that are learned, as start:end, comma-joined: each trained turn's text
    and end mark."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(a, t):
        first, end = a["at"] + F.length(opened(t["role"])), a["at"] + F.length(rendered(t))
        span = F.concat_ws(":", first.cast("string"), (end - 1).cast("string"))
        return F.struct(end.cast("bigint").alias("at"), F.when(t["role"] == TRAINED, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def formatted(turns: DataFrame, pair: Column, rejected: Column, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair_id, paired, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask) per pair.

    `turns` holds one row per turn; `rejected` is true for turns of the rejected conversation. Turns are
    ordered by number, null first, then role and text, so repeated turns stay next to each other. The
    prompt is the longest run of first turns that are equal in role and text; each completion is the rest
    of its conversation, empty if nothing is left. Null roles and texts are empty. Where one side is
    missing, paired is false and the other side stands whole. Turns without a pair (a null key) are no
    conversation and are left out. A pair's turns meet in one row, as its output is one row.
    """
    safe = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |"))
    each = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), safe.alias("text"))
    rows = turns.select(pair.alias("pair_id"), rejected.alias("_rejected"), each.alias("_turn")).where("pair_id IS NOT NULL")
    sides = rows.groupBy("pair_id").agg(*[F.sort_array(F.collect_list(F.when(on, F.col("_turn")))).alias(n)
                                          for n, on in (("_chosen", ~F.col("_rejected")), ("_other", F.col("_rejected")))])
    same = F.zip_with("_chosen", "_other", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    split = F.array_position(same, False)
    found = sides.withColumn("n_prefix", F.when(split == 0, F.size(same)).otherwise(split - 1).cast("int"))
    prompt = F.slice("_chosen", F.lit(1), F.col("n_prefix"))
    rest = {n: F.slice(n, F.col("n_prefix") + 1, F.greatest(F.size(n) - F.col("n_prefix"), F.lit(0))) for n in ("_chosen", "_other")}
    return found.select("pair_id", ((F.size("_chosen") > 0) & (F.size("_other") > 0)).alias("paired"), "n_prefix", text_of(prompt).alias("prompt"),
                        text_of(rest["_chosen"]).alias("chosen"), text_of(rest["_other"]).alias("rejected"),
                        trained_spans(rest["_chosen"]).alias("chosen_mask"), trained_spans(rest["_other"]).alias("rejected_mask"))


def op6(spark, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are a pair, the first one chosen."""
    turns = read(spark, sf_dir, "conversations")
    return formatted(turns, F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(1) == 1)


def _mask_sql(side: str) -> str:
    open_, all_ = "len(x.role) + 5", "len(x.role) + len(x.text) + 13"
    at = f"coalesce(list_sum(list_transform({side}[1:i - 1], lambda x: {all_})), 0)"
    return (f"array_to_string(list_filter(list_transform(range(1, len({side}) + 1), lambda i: CASE WHEN {side}[i].role = '{TRAINED}' THEN "
            f"concat(({at} + len({side}[i].role) + 5)::BIGINT, ':', ({at} + len({side}[i].role) + len({side}[i].text) + 12)::BIGINT) END), lambda s: s IS NOT NULL), ',')")


def _text_sql(side: str) -> str:
    return f"coalesce(array_to_string(list_transform({side}, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '')"


_LIST = "coalesce(list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE side = %d), [])"
ORACLE = f"""WITH t AS (SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, turn, coalesce(role, '') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT pair_id, {_LIST % 0} AS c, {_LIST % 1} AS r FROM t GROUP BY 1),
k AS (SELECT *, coalesce(list_position(list_transform(range(1, greatest(len(c), len(r)) + 1), lambda i: coalesce(c[i] = r[i], false)), false) - 1, len(c)) AS n FROM g),
s AS (SELECT pair_id, n, c[1:n] AS p, c[n + 1:] AS a, r[n + 1:] AS b, len(c) > 0 AND len(r) > 0 AS paired FROM k)
SELECT pair_id, paired, n::INTEGER AS n_prefix, {_text_sql('p')} AS prompt, {_text_sql('a')} AS chosen, {_text_sql('b')} AS rejected,
{_mask_sql('a')} AS chosen_mask, {_mask_sql('b')} AS rejected_mask FROM s"""
