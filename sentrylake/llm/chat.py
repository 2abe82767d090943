"""Chat formatting by quotation linking, with built-in functions only.

Lines that begin with > marks are quotes, one level a mark; neighbouring lines of one level are a passage. Passages,
their windows of `WINDOW` words (over line ends, so that wrapping does not matter) and their lines are normalised (lower
case, letters and digits, single blanks) and hashed, and the hashes are joined to those of the unquoted passages of the
messages of the conversation that first said them. A quoted passage links to the message that said the whole of it; else to
the one that said most of its windows and to those that said a line of `WINDOW` words and more of it; else to those that
said its short lines. Less than `WINDOW` words out of a longer line link to nothing. A message answers the latest earlier message that it quotes at level
1, else the one before it. Conversations are ordered so that a quoting answer follows what it answers, and each message
loses its quotes and the lines that introduce them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.common import bind, stored

PREFIX = r"^[ \t]*>[ \t>]*"
WINDOW = 4
INTRODUCTION = r"^(On|Am|Le|El) .*(wrote|schrieb|écrit|escribió)\s*:\s*$"


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def parsed_lines(text: Column) -> Column:
    """array<struct<level, body>>; an introducing line before a quote has level -1."""
    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda x: bind(
            F.regexp_extract(x, PREFIX, 0),
            lambda p: F.struct((F.length(p) - F.length(F.translate(p, ">", ""))).alias("level"), F.regexp_replace(x, PREFIX, "").alias("body")),
        ),
    )

    def mark(a: Column) -> Column:
        shifted = F.concat(F.slice(a, 2, F.size(a)), F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("body"))))
        return F.zip_with(
            a,
            shifted,
            lambda x, y: F.struct(F.when((x["level"] == 0) & (y["level"] > 0) & F.rlike(x["body"], F.lit(INTRODUCTION)), F.lit(-1)).otherwise(x["level"]).alias("level"), x["body"].alias("body")),
        )

    return bind(lines, mark)


def passages(lines: Column) -> Column:
    """array<struct<level, at, said>>: runs of neighbouring lines of one level, `said` their normalised lines but empty ones."""

    def cut(a: Column) -> Column:
        changes = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: (i == 1) | (F.get(a, i - 1)["level"] != F.get(a, i - 2)["level"]))

        def runs(starts: Column) -> Column:
            ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(a) + 1))
            return F.zip_with(
                starts,
                ends,
                lambda s, e: F.struct(
                    F.get(a, s - 1)["level"].alias("level"),
                    s.alias("at"),
                    F.filter(F.transform(F.slice(a, s, e - s), lambda x: normalised(x["body"])), lambda x: x != "").alias("said"),
                ),
            )

        return bind(changes, runs)

    return bind(lines, cut)


WHOLE, PART, LINE, SHORT_LINE = range(4)


def pieces(said: Column, window: int = WINDOW) -> Column:
    """array<struct<kind, h>> of a passage's lines, each once."""

    def made(words: Column) -> Column:
        parts = F.when(
            F.size(words) >= window, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - window + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, window), " "))
        ).otherwise(F.array().cast("array<string>"))
        each = lambda texts, kind: F.transform(texts, lambda x: F.concat(kind(x).cast("string"), F.md5(x)))
        # a digit and the hash: texts are told apart by hashing, structs would be compared pair by pair
        found = F.array_distinct(
            F.concat(
                each(F.array(F.array_join(words, " ")), lambda x: F.lit(WHOLE)),
                each(parts, lambda x: F.lit(PART)),
                each(said, lambda x: F.when(F.size(F.split(x, " ")) >= window, F.lit(LINE)).otherwise(F.lit(SHORT_LINE))),
            )
        )
        return F.transform(found, lambda x: F.struct(F.substring(x, 1, 1).cast("int").alias("kind"), F.substring(x, 2, 32).alias("h")))

    return bind(F.split(F.array_join(said, " "), " "), made)


def sources(lines: DataFrame) -> DataFrame:
    """(_conv, _turn, level, source): the earlier messages that quoted passages link to. lines: (_conv, _turn, _lines)."""
    quoting = stored(lines.where(F.exists("_lines", lambda x: x["level"] >= 1)).select("_conv").distinct(), "quoting")
    said = lines.join(quoting, "_conv", "left_semi").select("_conv", "_turn", F.explode(passages(F.col("_lines"))).alias("p")).select("_conv", "_turn", "p.*")
    each = said.where((F.col("level") >= 0) & (F.size("said") > 0)).select("_conv", "_turn", "level", "at", F.explode(pieces(F.col("said"))).alias("x"))
    each = each.select("_conv", "_turn", "level", "at", "x.kind", "x.h")
    # who said it first: one row a piece and conversation, combined before the shuffle
    first = each.where("level = 0").groupBy("_conv", "kind", "h").agg(F.min("_turn").alias("source"))
    quoted = each.where("level >= 1").distinct()
    found = quoted.join(first, ["_conv", "kind", "h"]).where("source < _turn").groupBy("_conv", "_turn", "level", "at", "kind", "source").agg(F.count(F.lit(1)).alias("n"))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    by_passage = found.groupBy("_conv", "_turn", "level", "at").agg(
        F.min(of(WHOLE, F.col("source"))).alias("whole"),
        F.min(of(PART, F.struct((-F.col("n")).alias("n"), "source")))["source"].alias("most"),
        F.collect_set(of(LINE, F.col("source"))).alias("lines"),
        F.collect_set(of(SHORT_LINE, F.col("source"))).alias("short"),
    )
    best = F.when(F.col("whole").isNotNull(), F.array("whole")).when(F.col("most").isNotNull(), F.array_union(F.array("most"), "lines"))
    return by_passage.select("_conv", "_turn", "level", F.explode(best.when(F.size("lines") > 0, F.col("lines")).otherwise(F.col("short"))).alias("source"))


def ordered(df: DataFrame, keys: list[str], group: str, out: str) -> DataFrame:
    """Add the place, from 1, of each row within `group` by `keys`; a group may be larger than a task.

    Rows are dealt by ranges of (group, keys); counts of the ranges (a row for each range and group that shares it)
    give the rows before a range.
    """
    ranged = df.repartitionByRange(group, *keys).withColumn("_part", F.spark_partition_id())
    # written, as both uses must see the same ranges
    placed = stored(ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part", group).orderBy(*keys))), "ranges")
    counts = placed.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = placed.join(before.drop("_n"), ["_part", group])
    return joined.withColumn(out, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def link_quotes(df: DataFrame, conv: str = "conv_id", turn: str = "turn", column: str = "text") -> DataFrame:
    """`df` with `column` free of quotes, plus n_quotes (passages), quote_level, n_linked, reply_to and reply_order.

    Null text counts as empty and stays null. Rows that share conversation and turn are one message for linking, and
    all stay. Rows without conversation or turn link to nothing and have no reply_to or reply_order. Columns named like
    the five added give way; others are kept, whatever their names. An empty table gives none. reply_order of rows alike in all but other columns follows their text.
    """
    added = ["n_quotes", "quote_level", "n_linked", "reply_to", "reply_order"]
    kept = [c for c in df.columns if c not in added]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    # columns go by number inside, so that no name clashes
    own_name = {c: f"c{k}" for k, c in enumerate(kept)}
    # of the text the lines are kept, and whether it is null
    row = F.struct(*[(quoted(c).isNotNull() if c == column else quoted(c)).alias(n) for c, n in own_name.items()])
    # written, as four steps read the lines
    lines = stored(df.select(row.alias("_row"), quoted(conv).alias("_conv"), quoted(turn).alias("_turn"), parsed_lines(quoted(column)).alias("_lines")), "lines")
    known = F.col("_conv").isNotNull() & F.col("_turn").isNotNull()
    linked = sources(lines.where(known).select("_conv", "_turn", "_lines"))
    answers = linked.groupBy("_conv", "_turn").agg(
        F.max(F.when(F.col("level") == 1, F.col("source"))).alias("answered"), F.count_distinct("source").alias("n_linked")
    )

    turns = ordered(lines.where(known).select("_conv", "_turn").distinct(), ["_turn"], "_conv", "_place")
    previous = turns.select("_conv", (F.col("_place") + 1).alias("_place"), F.col("_turn").alias("before"))
    messages = turns.join(previous, ["_conv", "_place"], "left").join(answers, ["_conv", "_turn"], "left").select(
        "_conv", "_turn", "answered", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("answered", "before").alias("reply_to"),
    )
    own = F.filter("_lines", lambda x: x["level"] == 0)

    def n_passages(a: Column) -> Column:
        """Level of each line beside the one before it: a passage begins where it changes to a quote."""
        levels = F.transform(a, lambda x: F.greatest(x["level"], F.lit(0)))
        return bind(levels, lambda v: F.size(F.filter(F.zip_with(v, F.concat(F.array(F.lit(0)), F.slice(v, 1, F.size(v) - 1)), lambda x, y: (x > 0) & (x != y)), lambda b: b)))

    texts = lines.select(
        "_row",
        "_conv",
        "_turn",
        F.trim(F.array_join(F.transform(own, lambda x: x["body"]), "\n")).alias("_clean"),
        n_passages(F.col("_lines")).alias("n_quotes"),
        F.greatest(F.array_max(F.transform("_lines", lambda x: x["level"])), F.lit(0)).alias("quote_level"),
    )
    joined = texts.join(messages, ["_conv", "_turn"], "left")
    place = joined.where(known).select("*", F.coalesce("answered", "_turn").alias("_at"), F.when(F.col("answered").isNotNull(), 1).otherwise(0).alias("_answer"))
    out = ordered(place, ["_at", "_answer", "_turn", "_clean"], "_conv", "reply_order").drop("_at", "_answer")
    rest = joined.where(~known).withColumn("reply_order", F.lit(None).cast("long"))
    both = out.withColumn("reply_order", F.col("reply_order").cast("long")).unionByName(rest)
    held = lambda c: F.col("_row")[own_name[c]]
    columns = [F.when(held(c), F.col("_clean")).alias(c) if c == column else held(c).alias(c) for c in kept]
    return both.select(*columns, "n_quotes", "quote_level", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to", "reply_order")


def with_quotes(df: DataFrame) -> DataFrame:
    """Conversations as (conv_id, turn, role, text) in which messages quote: by conversation and turn, the whole message before, its words 2
    to 9 over two lines at level 2, the words 3 to 12 of the one before that and its last line under an introduction, or
    words that nobody said; a third quote nothing. A fixture for tables without quotes."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    words = lambda c, a, n: F.array_join(F.slice(F.split(c, r"[ \n]+"), a, n), " ")
    last_line = lambda c: F.element_at(F.split(c, "\n", -1), -1)
    held = df.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumns({"_a": F.lag("text").over(w), "_b": F.lag("text", 2).over(w), "_m": F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))})
    quoted = (
        F.when((F.col("_m") == 0) & F.col("_a").isNotNull(), F.concat(F.lit("> "), F.regexp_replace("_a", "\n", "\n> "), F.lit("\n")))
        .when((F.col("_m") == 1) & F.col("_a").isNotNull(), F.concat(F.lit(">> "), words("_a", 2, 4), F.lit("\n> > "), words("_a", 6, 4), F.lit("\n")))
        .when((F.col("_m") == 2) & F.col("_b").isNotNull(), F.concat(F.lit("On Monday A wrote:\n> "), F.upper(words("_b", 3, 10)), F.lit("\nso\n> "), last_line("_b"), F.lit("\n")))
        .when(F.col("_m") == 3, F.lit("> nobody ever said these words\n"))
        .otherwise("")
    )
    return held.select("conv_id", "turn", "role", F.concat(quoted, "text").alias("text"))


#: The same conversations in DuckDB, as `c`.
QUOTED = r"""q AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lag(coalesce(text, '')) OVER w AS a, lag(coalesce(text, ''), 2) OVER w AS b, (conv_id + turn) % 6 AS m FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT conv_id, turn, role, CASE WHEN m = 0 AND a IS NOT NULL THEN '> ' || replace(a, chr(10), chr(10) || '> ') || chr(10)
  WHEN m = 1 AND a IS NOT NULL THEN '>> ' || array_to_string(string_split_regex(a, '[ \n]+')[2:5], ' ') || chr(10) || '> > ' || array_to_string(string_split_regex(a, '[ \n]+')[6:9], ' ') || chr(10)
  WHEN m = 2 AND b IS NOT NULL THEN 'On Monday A wrote:' || chr(10) || '> ' || upper(array_to_string(string_split_regex(b, '[ \n]+')[3:12], ' ')) || chr(10) || 'so' || chr(10) || '> ' || string_split(b, chr(10))[-1] || chr(10)
  WHEN m = 3 THEN '> nobody ever said these words' || chr(10) ELSE '' END || text AS text FROM q),"""


def oracle(source: str = "c AS (SELECT * FROM conversations),") -> str:
    """Passages, windows and lines in DuckDB, over the conversations that `source` makes."""
    return rf"""
WITH {source}
line AS (SELECT conv_id, turn, role, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM c),
lev AS (SELECT *, regexp_extract(x, '^[ \t]*>[ \t>]*') AS p FROM line),
lv AS (SELECT conv_id, turn, role, i, len(p) - len(replace(p, '>', '')) AS l0, substr(x, len(p) + 1) AS body FROM lev),
m AS (SELECT *, CASE WHEN l0 = 0 AND coalesce(lead(l0) OVER w, 0) > 0 AND regexp_matches(body, '^(On|Am|Le|El) .*(wrote|schrieb|écrit|escribió)\s*:\s*$') THEN -1 ELSE l0 END AS level,
             coalesce(lag(greatest(l0, 0)) OVER w, 0) AS prev FROM lv WINDOW w AS (PARTITION BY conv_id, turn, role ORDER BY i)),
n AS (SELECT *, trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS said, coalesce(level <> lag(level) OVER w, true) AS cut FROM m WINDOW w AS (PARTITION BY conv_id, turn, role ORDER BY i)),
g AS (SELECT *, max(CASE WHEN cut THEN i END) OVER (PARTITION BY conv_id, turn, role ORDER BY i) AS start FROM n),
pa AS (SELECT conv_id, turn, role, level, start, string_agg(said, ' ' ORDER BY i) AS whole FROM g WHERE level >= 0 AND said <> '' GROUP BY ALL),
pw AS (SELECT *, string_split(whole, ' ') AS words FROM pa),
pc AS (SELECT conv_id, turn, level, start, 0 AS kind, whole AS piece FROM pa
  UNION SELECT conv_id, turn, level, start, 1, array_to_string(words[k:k + {WINDOW - 1}], ' ') FROM (SELECT *, unnest(range(1, len(words) - {WINDOW - 2})) AS k FROM pw WHERE len(words) >= {WINDOW})
  UNION SELECT conv_id, turn, level, start, CASE WHEN len(string_split(said, ' ')) >= {WINDOW} THEN 2 ELSE 3 END, said FROM g WHERE level >= 0 AND said <> ''),
f AS (SELECT conv_id, kind, piece, min(turn) AS source FROM pc WHERE level = 0 GROUP BY ALL),
fo AS (SELECT q.conv_id, q.turn, q.level, q.start, kind, f.source, count(*) AS n FROM pc q JOIN f USING (conv_id, kind, piece) WHERE q.level >= 1 AND f.source < q.turn GROUP BY ALL),
bp AS (SELECT conv_id, turn, level, start, min(source) FILTER (WHERE kind = 0) AS whole, arg_min(source, (-n, source)) FILTER (WHERE kind = 1) AS most,
  coalesce(list(DISTINCT source) FILTER (WHERE kind = 2), []) AS lines, coalesce(list(DISTINCT source) FILTER (WHERE kind = 3), []) AS short FROM fo GROUP BY ALL),
k AS (SELECT DISTINCT conv_id, turn, level, unnest(CASE WHEN whole IS NOT NULL THEN [whole] WHEN most IS NOT NULL THEN list_append(lines, most) WHEN len(lines) > 0 THEN lines ELSE short END) AS source FROM bp),
a AS (SELECT conv_id, turn, max(source) FILTER (WHERE level = 1) AS answered, count(DISTINCT source) AS n_linked FROM k GROUP BY ALL),
t AS (SELECT conv_id, turn, role, trim(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0), '')) AS text,
             CAST(count(*) FILTER (WHERE level > 0 AND level <> prev) AS INT) AS n_quotes, CAST(greatest(max(level), 0) AS INT) AS quote_level FROM n GROUP BY conv_id, turn, role)
SELECT t.*, coalesce(n_linked, 0) AS n_linked, coalesce(answered, lag(t.turn) OVER (PARTITION BY t.conv_id ORDER BY t.turn)) AS reply_to,
       row_number() OVER (PARTITION BY t.conv_id ORDER BY coalesce(answered, t.turn), CASE WHEN answered IS NULL THEN 0 ELSE 1 END, t.turn, t.text) AS reply_order
FROM t LEFT JOIN a ON a.conv_id = t.conv_id AND a.turn = t.turn
"""


ORACLE = oracle()
ORACLE_QUOTED = oracle(QUOTED)
