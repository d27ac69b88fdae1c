"""Chat formatting as a relation: sort, merge, concatenate, in Spark expressions only.

Template.  Adjacent turns of one role become one block; the turns inside stay apart::

    <|open|>role<|text|>first text<|next|>second text<|end|>

Every ``<`` of a role or text is written ``<~``, so no text can hold a control
string, whatever it says, and putting ``<`` back for ``<~`` restores it exactly.

The loss mask is an array of ``(segment, chars)``: cut the formatted string after
each control string; of segment number ``segment`` (from 0) the first ``chars`` code
points are trained on.  Cutting is linear in the length, where character offsets
into one long string would be walked from its start each time.

Null roles and texts count as empty; a null conversation is one of its own; equal
turn numbers are ordered by role, then text, and null turn numbers come first.
Other columns are ignored.  A conversation is one output row and is held whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, TEXT, NEXT, END = "<|open|>", "<|text|>", "<|next|>", "<|end|>"
_AFTER = r"(?<=<\\|(?:open|text|next|end)\\|>)"


def escape(e: str) -> str:
    return f"replace({e}, '<', '<~')"


def unescape(e: str) -> str:
    return f"replace({e}, '<~', '<')"


def format_chats(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted string, loss_mask array<struct<segment int, chars bigint>>."""
    role_is = " OR ".join(f"b.role = '{r}'" for r in trained)
    t = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    t = t.selectExpr("conv_id", "ts", "filter(sequence(0, size(ts) - 1), i -> i = 0 OR ts[i].role != get(ts, i - 1).role) AS starts")
    t = t.selectExpr("conv_id", "transform(starts, (s, j) -> named_struct('role', ts[s].role, 'at', s, 'texts', transform(slice(ts, s + 1, coalesce(get(starts, j + 1), size(ts)) - s), x -> " + escape("x.text") + "))) AS blocks")
    one = f"concat('{OPEN}', {escape('b.role')}, '{TEXT}', array_join(b.texts, '{NEXT}'), '{END}')"
    # a block has two segments before its first text, and one for each text
    mask = f"flatten(transform(filter(transform(blocks, (b, j) -> named_struct('role', b.role, 'first', 2 * (j + 1) + b.at, 'texts', b.texts)), b -> {role_is}), b -> transform(b.texts, (x, i) -> named_struct('segment', b.first + i, 'chars', CAST(length(x) AS BIGINT)))))"
    return t.selectExpr("conv_id", f"array_join(transform(blocks, b -> {one}), '') AS formatted", f"{mask} AS loss_mask")


def parsed(formatted: str = "formatted") -> Column:
    """array<struct<role, texts array>> read back from a formatted string."""
    cut = rf"filter(split({formatted}, '<\\|end\\|>'), x -> x != '')"
    role = f"{unescape(f'substring_index(substr(b, {len(OPEN) + 1}), {chr(39)}{TEXT}{chr(39)}, 1)')}"
    texts = rf"transform(split(substr(b, locate('{TEXT}', b) + {len(TEXT)}), '<\\|next\\|>'), x -> {unescape('x')})"
    return F.expr(f"transform({cut}, b -> named_struct('role', {role}, 'texts', {texts}))")


def trained_texts(formatted: str = "formatted", mask: str = "loss_mask") -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.expr(f"transform(array(split({formatted}, '{_AFTER}')), s -> transform({mask}, m -> {unescape('left(s[m.segment], CAST(m.chars AS INT))')}))[0]")


def query(turns: DataFrame) -> DataFrame:
    spark = turns.sparkSession
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = format_chats(turns.select("conv_id", "turn", "role", "text").unionByName(extra))
    out = out.select("conv_id", "formatted", parsed().alias("blocks"), trained_texts().alias("trained"))
    return out.selectExpr(
        "conv_id",
        "CAST(aggregate(blocks, 0, (a, b) -> a + size(b.texts)) AS BIGINT) AS n_turns",
        r"sha2(array_join(flatten(transform(blocks, b -> transform(b.texts, x -> concat(b.role, '\n', x, '\n')))), ''), 256) AS turns_sha256",
        "CAST(length(array_join(trained, '')) AS BIGINT) AS loss_chars",
        "sha2(array_join(trained, ''), 256) AS loss_sha256",
        "CAST(length(formatted) AS BIGINT) AS formatted_chars",
    )


ORACLE_SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, x, y, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(x, y)),
o AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS starts,
  length(replace(text, '<', '<~')) AS text_chars, length(replace(role, '<', '<~')) AS role_chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN starts THEN role_chars + {len(OPEN + TEXT + END)} ELSE {len(NEXT)} END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id"""
