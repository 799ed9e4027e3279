"""Chat formatting in Spark expressions: sorted turn structs, runs of one role merged by array aggregation, one string each.

Template, whose five strings are control strings:

    <|im_start|>ROLE<|im_sep|>TEXT[<|im_sep|>TEXT...]<|im_end|> ...

Adjacent turns of one role share a block, their texts between separators, so that turns can
be read back.  Roles and texts are escaped: a backslash follows every backslash and the
first character of every control string (`<|`, `<s>`, `</s>`, `[INST]`, `[/INST]`), so none
of these occurs in an escaped text; unescaping drops the backslash after which each pair
stands.  The loss mask has the spans of assistant texts, as code points of the string.

Nulls: a null role or text is an empty one, a null conv_id is a conversation of its own.
Turns of equal number (repeated rows too) are ordered by role, then text; null turns are
first.  An empty table gives no rows.  A text of any length is whole; other columns are
dropped, whatever their names.  A conversation is one string, so it is one row of one task,
in about linear time (its number of turns to the power 1.5, in numbers of eight bytes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Code points of a long string that are read together, at least.
STRETCH = 4096
_CONTROL = r"(\\|<(?=\||/?s>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_CONTROL), F.lit(r"$1\\"))


def unescape(text: Column) -> Column:
    r"""The character before every backslash of a pair stays: `\\` is a backslash, `<\` is `<`."""
    return F.regexp_replace(text, F.lit(r"(?s)(\\|<|\[)\\"), F.lit("$1"))


def _running(numbers: Column) -> Column:
    """The sum of what stands before each number.

    A fold that appends copies what it has, so it runs over stretches as long as the square
    root of the whole, and once over the stretches' sums.
    """
    n = F.size(numbers)
    wide = F.ceil(F.sqrt(n.cast("double"))).cast("int")
    stretches = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / wide).cast("int")), lambda k: F.slice(numbers, k * wide + 1, wide))
    sums = F.transform(stretches, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b))
    up = lambda x, start: F.aggregate(x, F.array(start), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + b)))
    bases = F.slice(up(sums, F.lit(0).cast("long")), 1, F.size(stretches))
    return F.flatten(F.zip_with(stretches, bases, lambda x, base: up(F.slice(x, 1, F.size(x) - 1), base)))


def format_chats(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> conv_id, formatted, loss (start, length of each assistant text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    escaped = lambda x: F.struct(escape(x["role"]).alias("role"), escape(x["text"]).alias("text"), (x["role"] == "assistant").alias("learned"))
    chats = chats.select("conv_id", F.transform("t", escaped).alias("t"))
    # Where a run of one role begins; each run becomes a block, its texts joined.
    opens = lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"])
    chats = chats.withColumn("opens", F.filter(F.sequence(F.lit(0), F.size("t") - 1), opens))
    end = lambda j: F.coalesce(F.get("opens", j + 1), F.size("t"))
    run = lambda i, j: F.struct(F.get("t", i)["role"].alias("role"), F.slice("t", i + 1, end(j) - i)["text"].alias("texts"))
    block = lambda b: F.concat(F.lit(START), b["role"], F.lit(SEPARATOR), F.array_join(b["texts"], SEPARATOR))
    formatted = F.concat(F.array_join(F.transform(F.transform("opens", run), block), END), F.lit(END))
    # What stands before a text: the end of another block and its own head, or a separator.
    own = lambda x, i: F.when(~opens(i), 0).otherwise(F.when(i > 0, len(END)).otherwise(0) + len(START) + F.length(x["role"])) + len(SEPARATOR)
    chats = chats.select("conv_id", "t", formatted.alias("formatted"), F.transform("t", lambda x, i: own(x, i).cast("long")).alias("heads"))
    # Arrays are zipped, not looked up in: what a lambda names may be put into it and computed for every element.
    chats = chats.withColumn("wide", F.zip_with("t", "heads", lambda x, h: h + F.length(x["text"])))
    starts = F.zip_with(_running(F.col("wide")), F.col("heads"), lambda a, b: a + b)
    place = F.zip_with("t", starts, lambda x, a: F.struct(x["learned"].alias("learned"), a.alias("start"), F.length(x["text"]).cast("long").alias("length")))
    loss = F.transform(F.filter(place, lambda x: x["learned"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return chats.select("conv_id", "formatted", loss.alias("loss"))


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, loss -> with turns (role, text) and learned, the texts under the mask, read from the string."""
    blocks = F.slice(F.split("formatted", r"<\|im_end\|>"), 1, F.size(F.split("formatted", r"<\|im_end\|>")) - 1)
    cut = F.transform(blocks, lambda b: F.split(F.substring(b, len(START) + 1, 1 << 30), r"<\|im_sep\|>"))
    turns = F.flatten(F.transform(cut, lambda p: F.transform(F.slice(p, 2, F.size(p) - 1), lambda x: F.struct(unescape(p[0]).alias("role"), unescape(x).alias("text")))))
    # A substring is found by counting from the string's begin, so a long string is cut into stretches, as long as the
    # square root of the whole at least, and a span is read from those that it touches.
    wide = F.greatest(F.lit(STRETCH), F.ceil(F.sqrt(F.length("formatted").cast("double"))).cast("int"))
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.length("formatted") - 1) / wide).cast("int")), lambda k: F.col("formatted").substr(k * wide + 1, wide))
    cut_up = chats.select("*", turns.alias("turns"), wide.alias("wide"), stretches.alias("stretches"))
    first = lambda s: F.floor(s["start"] / F.col("wide")).cast("int")
    last = lambda s: F.least(F.size("stretches"), F.floor((s["start"] + s["length"]) / F.col("wide")).cast("int") + 1)
    around = lambda s: F.array_join(F.slice("stretches", first(s) + 1, last(s) - first(s)), "")
    learned = F.transform("loss", lambda s: unescape(around(s).substr((s["start"] - first(s) * F.col("wide") + 1).cast("int"), s["length"].cast("int"))))
    return cut_up.select(*chats.columns, "turns", learned.alias("learned"))


def digests(chats: DataFrame) -> DataFrame:
    """What read_chats() gives as counts and checksums."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (
  SELECT *, lag(role) OVER w AS prior,
    length(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS body,
    length(replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS head
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(body + 10 + CASE WHEN prior IS NOT DISTINCT FROM role THEN 0 ELSE head + 12 + 10 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
