"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Equal lines are found by hash. Near lines are one edit apart: a unit put in, left out or replaced.
The unit is a word in lines of WORDS words or more, so that the bound grows with the line, and a
character in shorter ones. Lines one edit apart share a deletion variant: a replacement at place i
leaves the same rest when i is left out of both, an insertion leaves the shorter line. Lines are cut
into halves first, and only those that share a half with another go on, which loses no pair: an edit
is in one half, and the other is the same in both. Of those all deletion variants are emitted that
leave out a unit of the half that is not shared; a variant is hashed in three parts, what stands in the chunks before and after the one or two chunks
with the edit, which are hashed once for all places, and the rest of those. So a line costs what it
has units, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeparts.llm.common import cut

#: Shorter lines (in characters) are left alone; blank ones always are.
MIN_CHARS = 1
#: Shorter lines are compared for equality only: one character is too large a part of them.
NEAR_CHARS = 16
#: Lines of so many words or more are edited word by word, others character by character.
WORDS = 8
#: Units of a chunk.
CHUNK = 32
#: Candidate lines up to which their places are sent to all executors (some MB) instead of shuffling the texts.
SMALL = 100_000
#: Stands for a doc_id that is null, so an id of this value comes last as well.
LAST = (1 << 63) - 1

PLACE = ("id", "th", "no")


def normal(line: Column) -> Column:
    """What two lines are compared by."""
    return F.lower(F.trim(line))


class _Units:
    """The units of a line ``s`` as columns: whether they are words, their number, and runs of them as text."""

    def __init__(self, s: str):
        """Of the column ``s`` of rows that ``counted`` has been given."""
        self.s, self.words, self.n = F.col(s), F.col(f"{s}_words"), F.col(f"{s}_n")

    @staticmethod
    def counted(rows: DataFrame, s: str) -> DataFrame:
        """``rows`` with what is known of the units of ``s``."""
        blanks = F.octet_length(s) - F.octet_length(F.replace(F.col(s), F.lit(" "), F.lit("")))
        words, n = F.col("blanks") >= WORDS - 1, F.col("blanks") + 1
        rows = rows.withColumn("blanks", blanks)
        return rows.withColumns({f"{s}_words": words, f"{s}_n": F.when(words, n).otherwise(F.char_length(s))}).drop("blanks")

    def first(self, k: Column) -> Column:
        return F.when(self.words, F.call_function("substring_index", self.s, F.lit(" "), k)).otherwise(F.substring(self.s, F.lit(1), k))

    def last(self, k: Column) -> Column:
        return F.when(self.words, F.call_function("substring_index", self.s, F.lit(" "), -k)).otherwise(F.substring(self.s, self.n - k + 1, k))

    def array(self) -> Column:
        return F.when(self.words, F.split(self.s, " ")).otherwise(F.split(self.s, ""))


def _rows(docs: DataFrame) -> DataFrame:
    """(id, th, lines): a row without an id comes after all others; th tells rows with one id and other texts apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("th"), F.split(text, "\n").alias("lines")
    )


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(id, th, no, h1, h2, halves) of every line of at least ``min_chars`` characters that is not blank; narrow, without the texts.

    ``halves`` has hashes of the first and second half of the units, for a partner as long and for one
    that is one unit shorter.
    """
    lines = _rows(docs).select("id", "th", F.posexplode("lines").alias("no", "line"))
    lines = lines.select(*PLACE, normal(F.col("line")).alias("s"))
    lines = lines.where(F.char_length("s") >= min_chars if min_chars > 1 else F.col("s") != "")
    lines = _Units.counted(lines, "s")
    units = _Units("s")
    near, n, half = units.words | (units.n >= near_chars), units.n, F.floor(units.n / 2).cast("int")
    odd = n % 2 == 1  # of the four halves, two are the same units
    parts = units.first(half), units.last(n - half), F.when(odd, units.last(half)).otherwise(units.first(half - 1))
    lines = lines.select(
        *PLACE, F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2"), "s_words", "s_n",
        *(F.when(near, F.xxhash64(x)).alias(f"x{i}") for i, x in enumerate(parts)),
    )
    a, b = F.when(odd, F.col("x0")).otherwise(F.col("x2")), F.when(odd, F.col("x2")).otherwise(F.col("x1"))
    keys = [F.xxhash64("s_words", base, F.lit(i % 2), x) for i, (base, x) in enumerate(((n, "x0"), (n, "x1"), (n - 1, a), (n - 1, b)))]
    return lines.select(*PLACE, "h1", "h2", F.when(F.col("x0").isNotNull(), F.array(*keys)).alias("halves"))


def _shared(rows: DataFrame, *key: str) -> DataFrame:
    """The ``rows`` whose key another row has too; counted before the join, so that a frequent key is summed up early."""
    counts = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(counts, [*key], "left_semi")


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(id, th, no, shared, s, and what is known of its units) of the lines at ``places`` (id, th, no, shared)."""
    wanted = cut(places.groupBy("id", "th").agg(F.collect_list(F.struct("no", "shared")).alias("nos")))
    if wanted.agg(F.coalesce(F.sum(F.size("nos")), F.lit(0))).first()[0] <= SMALL:
        wanted = F.broadcast(wanted)
    found = _rows(docs).join(wanted, ["id", "th"])
    found = found.select("id", "th", "lines", F.explode("nos").alias("at")).select(
        "id", "th", "at.*", normal(F.element_at("lines", F.col("at.no") + 1)).alias("s")
    )
    return _Units.counted(found, "s")


def _chain(units: Column, n: Column, from_end: bool) -> Column:
    """Hashes of the first (or last) 0, 1, 2, ... chunks of an array of ``n`` units."""
    count = F.floor(n / CHUNK).cast("int")

    def chunk(j: Column) -> Column:
        return F.slice(units, (n - (j + 1) * CHUNK if from_end else j * CHUNK) + 1, F.lit(CHUNK))

    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(places, start, lambda done, j: F.concat(done, F.array(F.xxhash64(F.element_at(done, -1), chunk(j)))))


def _middles(lines: DataFrame) -> DataFrame:
    """(o, shorter, low, key, middle, from, to) of ``lines`` (o, shared, s), for each run of chunks that an edit can be in.

    ``key`` is a hash of the number of units of the shorter line of a pair, which is the line's own
    (``shorter``) or one less, and of the chunks around the ``middle``; that begins at the unit ``low``
    and has fewer than two chunks, or one more unit. The units from ``from`` up to ``to`` (in the
    middle, from 0) may be left out. ``shared`` has a bit for each of the halves that another line has.
    """
    cutup = lines.select("o", "shared", F.col("s_words").alias("words"), F.col("s_n").alias("n"), _Units("s").array().alias("units"))
    n = F.col("n")
    chains = cutup.select("o", "shared", "words", "n", "units", _chain(F.col("units"), n, False).alias("before"), _chain(F.col("units"), n, True).alias("after"))

    def around(base: Column, first: int) -> Column:
        """With the first half shared the edit is in the second, and the other way round."""
        last = F.greatest(F.floor(base / CHUNK).cast("int") - 1, F.lit(0))
        half = F.floor(base / 2).cast("int")
        begins, ends = (F.col("shared").bitwiseAND(F.lit(1 << (first + i))) != 0 for i in (0, 1))
        low, high = F.when(ends, F.lit(0)).otherwise(half), F.when(begins, n).otherwise(half + (n - base))

        def one(a: Column) -> Column:
            key = F.xxhash64("words", base, a, F.get("before", a), F.get("after", last - a))
            width, at = n - last * CHUNK, a * CHUNK
            middle = F.slice("units", at + 1, width)
            edges = F.greatest(low - at, F.lit(0)).alias("from"), F.least(high - at, width).alias("to")
            return F.struct((base == n).alias("shorter"), at.alias("low"), key.alias("key"), middle.alias("middle"), *edges)

        some = F.filter(F.transform(F.sequence(F.lit(0), last), one), lambda x: x["from"] < x["to"])
        return F.when(begins | ends, some).otherwise(F.slice(some, F.lit(1), F.lit(0)))

    return chains.select("o", F.explode(F.concat(around(n, 0), around(n - 1, 2))).alias("part")).select("o", "part.*")


def _pairs(lines: DataFrame) -> DataFrame:
    """(o, first, at): of the different ``lines`` (o, shared, s), each with earlier ones that share a deletion variant, and the unit that was left out."""
    width = F.size("middle")
    left_out = F.transform(
        F.sequence(F.col("from"), F.col("to") - 1),
        lambda i: F.struct(
            F.when(F.col("shorter"), i).otherwise(-1).alias("swap"),  # only a replacement needs the same place in both
            (F.col("low") + i).alias("at"),
            F.xxhash64(F.slice("middle", F.lit(1), i), F.slice(F.col("middle"), i + 2, width)).alias("rest"),
        ),
    )
    itself = F.array(F.struct(F.lit(-2).alias("swap"), F.lit(-1).alias("at"), F.xxhash64("middle").alias("rest")))
    variants = _middles(lines).select("o", "key", F.explode(F.when(F.col("shorter"), F.concat(left_out, itself)).otherwise(left_out)).alias("v"))
    variants = cut(variants.select("o", "key", "v.*"))
    # lines that differ at one place: all are within one edit of the earliest of them
    swapped = variants.where("swap >= 0")
    least = swapped.groupBy("key", "swap", "rest").agg(F.min("o").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = swapped.join(least, ["key", "swap", "rest"]).where(F.col("first") < F.col("o")).select("o", "first", "at")
    # a line and those that have one unit more
    whole = variants.where("swap = -2").select("key", "rest", F.col("o").alias("whole"))
    longer = variants.where("swap = -1").select("key", "rest", "o", "at").join(whole, ["key", "rest"])
    pairs = pairs.union(longer.select(F.greatest("o", "whole"), F.least("o", "whole"), "at"))
    return pairs.groupBy("o", "first").agg(F.min("at").alias("at"))


def _one_edit(a: str, b: str, at: Column) -> Column:
    """Whether two lines have the same units but for the unit ``at``, which one of them may not have."""
    x, y = _Units(a), _Units(b)
    rest = F.least(x.n, y.n) - at - (x.n == y.n).cast("int")
    return (x.words == y.words) & (F.abs(x.n - y.n) <= 1) & (x.first(at) == y.first(at)) & (x.last(rest) == y.last(rest))


def near_lines(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(o, first): of the different lines, those with an earlier line within one edit, and the earliest such line."""
    keys = classes.where("o.halves is not null").select(
        *(F.col(f"o.{c}").alias(c) for c in PLACE), F.posexplode("o.halves").alias("half", "key")
    )
    candidates = _shared(keys, "key").groupBy(*PLACE).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("half"))).alias("shared"))
    lines = cut(_texts(docs, candidates).select(F.struct(*PLACE).alias("o"), "shared", "s", "s_words", "s_n").distinct())
    pairs = _pairs(lines)
    lines = lines.drop("shared")
    verified = pairs.join(lines, "o").join(lines.toDF("first", "e", "e_words", "e_n"), "first")
    verified = verified.where(_one_edit("s", "e", F.col("at")))
    return verified.groupBy("o").agg(F.min("first").alias("first"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(id, th, no, first_id, first_no, near) of the lines that go.

    A line goes if an earlier one, by doc_id and place, is equal, or within one edit, after trimming
    and lower-casing; be that line kept or not. Blank lines and those of fewer than ``min_chars``
    characters stay; lines of fewer than ``near_chars`` characters and WORDS words go for equality
    only. Rows without a doc_id come last. A row that is given twice has its lines in one place, so
    neither copy loses them to the other.
    """
    lines = cut(line_table(docs, min_chars, near_chars))
    classes = cut(
        lines.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE, "halves")).alias("o"), F.count("*").alias("n"))
    )
    near = near_lines(docs, classes)
    more = classes.where("n > 1").select("h1", "h2", F.struct(*(F.col(f"o.{c}").alias(c) for c in PLACE)).alias("first"))
    exact = lines.join(more, ["h1", "h2"]).select(F.struct(*PLACE).alias("o"), "first").where("o <> first").distinct()
    return (
        exact.withColumn("near", F.lit(False))
        .union(near.withColumn("near", F.lit(True)))
        .select("o.*", F.col("first.id").alias("first_id"), F.col("first.no").alias("first_no"), "near")
    )


def report(docs: DataFrame, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """One row for each different row of ``docs``: what line dedup takes from it.

    doc_id, n_lines, the numbers (from 0) of lines that go because an earlier one is equal
    (exact_lines) or one edit apart (near_lines), and the ids of the documents with those earlier
    lines (first_docs); each a comma-joined string, empty if there are none. A null text has one
    empty line, as an empty one has. Extra columns are ignored. No rows give no rows.
    """
    gone = dropped_lines(docs, min_chars, near_chars).groupBy("id", "th").agg(
        F.array_sort(F.collect_set(F.when(~F.col("near"), F.col("no")))).alias("exact"),
        F.array_sort(F.collect_set(F.when(F.col("near"), F.col("no")))).alias("near"),
        F.array_sort(F.collect_set("first_id")).alias("first"),
    )
    rows = _rows(docs).select("id", "th", F.size("lines").cast("long").alias("n_lines")).distinct()

    def joined(c: str) -> Column:
        return F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit("")).alias(f"{c}_lines")

    return rows.join(gone, ["id", "th"], "left").select(
        F.when(F.col("id") < LAST, F.col("id")).alias("doc_id"), "n_lines", joined("exact"), joined("near"),
        joined("first").alias("first_docs"),
    )


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """``docs`` without the lines that go, with its columns; a text of which nothing but white space is left goes whole.

    A null or blank text that loses nothing stays as it is. n_chars, where there is such a column,
    follows the text.
    """
    gone = dropped_lines(docs, min_chars, near_chars).groupBy("id", "th").agg(F.collect_set("no").alias("nos"))
    names = docs.columns
    plain = docs.toDF(*[c if c in ("text", "doc_id") else f"c{i}" for i, c in enumerate(names)])
    keyed = plain.withColumns(
        {
            "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)),
            "th": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
        }
    )
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("nos", i)), "\n")
    joined = keyed.join(gone, ["id", "th"], "left").withColumn("text", F.when(F.col("nos").isNull(), F.col("text")).otherwise(left))
    joined = joined.where(F.col("nos").isNull() | F.col("text").rlike(r"\S"))
    out = joined.select(*plain.columns).toDF(*names)
    if "n_chars" in names:
        kind = out.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return out


REPORT_SQL = f"""
WITH rows AS (
  SELECT doc_id AS id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT id, no - 1 AS no, s FROM (
    SELECT id, unnest(range(1, len(lines) + 1)) AS no, lower(trim(unnest(lines))) AS s FROM rows
  ) WHERE length(s) >= {MIN_CHARS}
), classes AS (
  SELECT s, min((id, no)) AS o FROM lines GROUP BY s
), near AS (
  SELECT o, s, string_split(s, ' ') AS w, len(string_split(s, ' ')) >= {WORDS} AS words FROM classes
  WHERE length(s) >= {NEAR_CHARS} OR len(string_split(s, ' ')) >= {WORDS}
), variants AS (
  SELECT o, words, i, array_to_string(list_concat(w[1:i], w[i + 2:]), ' ') AS rest
  FROM (SELECT o, w, words, unnest(range(len(w))) AS i FROM near WHERE words)
  UNION ALL
  SELECT o, words, i, left(s, i::INT) || substr(s, i::INT + 2) FROM (SELECT o, s, words, unnest(range(length(s))) AS i FROM near WHERE NOT words)
), pairs AS (
  SELECT a.o, b.o AS first FROM variants a JOIN variants b ON a.rest = b.rest AND a.words = b.words AND a.i = b.i AND b.o < a.o
  UNION ALL
  SELECT greatest(a.o, b.o), least(a.o, b.o) FROM variants a JOIN near b ON a.rest = b.s AND a.words = b.words
), gone AS (
  SELECT (l.id, l.no) AS o, c.o AS first, false AS near FROM lines l JOIN classes c ON l.s = c.s WHERE (l.id, l.no) <> c.o
  UNION ALL
  SELECT o, min(first), true FROM pairs GROUP BY o
), by_doc AS (
  SELECT o[1] AS id, list(DISTINCT o[2] ORDER BY o[2]) FILTER (NOT near) AS exact,
    list(DISTINCT o[2] ORDER BY o[2]) FILTER (near) AS near, list(DISTINCT first[1] ORDER BY first[1]) AS first
  FROM gone GROUP BY 1
)
SELECT r.id AS doc_id, len(r.lines)::BIGINT AS n_lines, coalesce(array_to_string(exact, ','), '') AS exact_lines,
  coalesce(array_to_string(near, ','), '') AS near_lines, coalesce(array_to_string(first, ','), '') AS first_docs
FROM rows r LEFT JOIN by_doc USING (id)
"""
