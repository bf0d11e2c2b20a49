"""Preference formatting, in DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of
turns (equal role and text) is rendered once, as the prompt; what follows it is
rendered as the two completions. A completion's mask says for which code points
a loss is taken: runs ``<0 or 1>x<length>``, 1 for the text of assistant turns
and the line end that closes it, 0 for all else.

Defined results: turns are ordered by turn (null first), role, text; null role
and text count as empty; repeated turns stay; a conversation without a partner
makes no pair; turns without a conversation's id are in none; equal conversations
have empty completions and masks; other columns are ignored. One conversation's turns meet in one task, since they
become one text; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ASSISTANT = "assistant"


def _turn(x: Column) -> Column:
    return F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("\n"))


def _mask(x: Column) -> Column:
    head = F.char_length(x["role"]) + 5
    body = F.char_length(x["text"]) + 1
    return F.when(x["role"] == ASSISTANT, F.concat(F.lit("0x"), head.cast("string"), F.lit(",1x"), body.cast("string"))).otherwise(F.concat(F.lit("0x"), (head + body).cast("string")))


def formatted(pairs: DataFrame) -> DataFrame:
    """``pairs``: pair_id and the turns c of the chosen and r of the rejected conversation, in order (arrays of turn, role, text)."""
    least = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", F.lit(1), least), F.slice("r", F.lit(1), least), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    rows = pairs.where("size(c) > 0 and size(r) > 0").withColumn("same", same)
    rows = rows.withColumn("n_common", F.when(F.array_position("same", False) > 0, F.array_position("same", False).cast("int") - 1).otherwise(F.size("same"))).drop("same")
    text = lambda a: F.array_join(F.transform(a, _turn), "")
    rest = lambda a: F.slice(a, F.col("n_common") + 1, F.size(a))
    return rows.select(
        "pair_id",
        F.col("n_common").cast("bigint").alias("n_common"),
        text(F.slice("c", F.lit(1), F.col("n_common"))).alias("prompt"),
        text(rest("c")).alias("chosen"),
        text(rest("r")).alias("rejected"),
        F.array_join(F.transform(rest("c"), _mask), ",").alias("chosen_mask"),
        F.array_join(F.transform(rest("r"), _mask), ",").alias("rejected_mask"),
    )


def _sides(turns: DataFrame, pair: str, chosen: str) -> DataFrame:
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where(F.col(pair).isNotNull()).groupBy(F.col(pair).alias("pair_id")).agg(
        *(F.array_sort(F.collect_list(F.when(F.col(chosen) == flag, turn))).alias(name) for name, flag in (("c", True), ("r", False)))
    )


def preference_pairs(turns: DataFrame, pair: str, chosen: str) -> DataFrame:
    """``turns``: a pair's id, whether the turn is of the chosen conversation, turn, role, text."""
    return formatted(_sides(turns, pair, chosen))


def replies(conversations: DataFrame) -> DataFrame:
    """Each conversation as the chosen one of a pair; the rejected one ends in another conversation's reply.

    The rejected conversation has the same turns up to the last one of the
    assistant, in whose place it has the last one of the assistant in the
    neighbour (2k and 2k + 1 are neighbours) and ends. ``pair_id`` is the
    conversation's id. Without such a turn in both there is no pair.
    """
    turns = conversations.select(
        F.floor(F.col("conv_id") / 2).cast("bigint").alias("two"), (F.pmod(F.col("conv_id"), F.lit(2)) == 0).alias("even"), "turn", "role", "text"
    )
    both = _sides(turns, "two", "even")
    views = F.array(*(F.struct((2 * F.col("pair_id") + k).alias("id"), F.col(own).alias("own"), F.col(other).alias("other")) for k, own, other in ((0, "c", "r"), (1, "r", "c"))))
    each = both.select(F.explode(views).alias("v")).select("v.*")
    from_end = F.array_position(F.transform(F.reverse("own"), lambda x: x["role"]), ASSISTANT).cast("int")
    reply = F.try_element_at(F.filter("other", lambda x: x["role"] == ASSISTANT), F.lit(-1))
    found = each.withColumns({"last": F.when(from_end > 0, F.size("own") - from_end + 1), "reply": reply}).where("last is not null and reply is not null")
    return formatted(found.select(F.col("id").alias("pair_id"), F.col("own").alias("c"), F.concat(F.slice("own", F.lit(1), F.col("last") - 1), F.array("reply")).alias("r")))


REPLIES_SQL = """
with turns as (
  select conv_id, cast(floor(conv_id / 2.0) as bigint) as two, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k
  from conversations where conv_id is not null),
lasts as (select conv_id, any_value(two) as two, max(k) filter (where role = 'assistant') as last_k from turns group by conv_id),
pairs as (
  select a.conv_id as pair_id, a.last_k, b.conv_id as other, b.last_k as other_k
  from lasts a join lasts b on a.two = b.two and a.conv_id <> b.conv_id where a.last_k is not null and b.last_k is not null),
c as (select p.pair_id, t.k, t.role, t.text from pairs p join turns t on t.conv_id = p.pair_id),
r as (
  select p.pair_id, t.k, t.role, t.text from pairs p join turns t on t.conv_id = p.pair_id where t.k < p.last_k
  union all select p.pair_id, p.last_k, t.role, t.text from pairs p join turns t on t.conv_id = p.other and t.k = p.other_k),
common as (
  select p.pair_id, coalesce(min(c.k) filter (where c.role <> r.role or c.text <> r.text) - 1, any_value(p.last_k)) as n_common
  from pairs p join c on c.pair_id = p.pair_id join r on r.pair_id = p.pair_id and r.k = c.k group by p.pair_id),
shown as (
  select t.pair_id, t.is_chosen, t.k, m.n_common, '<|' || role || '|>' || chr(10) || text || chr(10) as shown,
    case when role = 'assistant' then '0x' || (length(role) + 5) || ',1x' || (length(text) + 1) else '0x' || (length(role) + length(text) + 6) end as mask
  from (select *, true as is_chosen from c union all select *, false from r) t join common m using (pair_id))
select pair_id, any_value(n_common) as n_common,
  coalesce(string_agg(shown, '' order by k) filter (where is_chosen and k <= n_common), '') as prompt,
  coalesce(string_agg(shown, '' order by k) filter (where is_chosen and k > n_common), '') as chosen,
  coalesce(string_agg(shown, '' order by k) filter (where not is_chosen and k > n_common), '') as rejected,
  coalesce(string_agg(mask, ',' order by k) filter (where is_chosen and k > n_common), '') as chosen_mask,
  coalesce(string_agg(mask, ',' order by k) filter (where not is_chosen and k > n_common), '') as rejected_mask
from shown group by pair_id
"""
