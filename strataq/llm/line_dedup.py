"""Line dedup with a segment-partition edit join; built-in functions only.

Lines within MAX_EDITS edits of each other share one of MAX_EDITS + 1 segments. A line is indexed under its own segments
and looks up the substrings of itself that can be a segment of a line as long as itself or one or two characters shorter,
at the places that the edits left and right of it allow. Candidates are verified with a banded bit-parallel edit distance.

A line goes if any earlier one is near it, so one witness is enough. Under a crowded key each line without a witness meets
the earliest lines of ever more parts of the key's lines, then all of them; whoever finds a witness asks no more. So neither
near copies nor other lines with a segment in common make a square of pairs, and none is skipped.

Lines travel as two 64-bit hashes; text is fetched again only for candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

MAX_EDITS = 2
#: Shorter lines are compared for equality alone; so few characters are too often near by chance.
LEAST_CHARS = 30
BLANKS = " \t\r\x0b\x0c"
#: So many rows of hashes are broadcast at most (24 MB); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
LAST = (1 << 63) - 1
#: Under a key that more lines are stored under, witnesses are looked for in rounds, each with GROWTH times the lines.
CROWD, GROWTH = 8, 16
#: Lines of one key that look for their witnesses in one task.
TOGETHER = 512
#: Pieces of a line for the filters before verification, the cheaper first: each edit spoils one of them at most.
PIECES = (8, 32)


def lines_of(text: Column) -> Column:
    """The text's lines with a letter or digit in them, without the blanks around them."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.filter(lines, has_word)


def has_word(line: Column) -> Column:
    return line.rlike(r"[\p{L}\p{N}]")


def identity(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")


def segment_keys(line: Column, size: Column) -> tuple[list[Column], list[int]]:
    """Hashes of all substrings that a line looks up, and which of them are its own segments.

    A line of n characters looks for lines of n - d characters, d = 0, 1, 2. Segment i of three, starting at p in the other
    line, may start here at p (first), p - 1 + d to p + 1 (second) or p + d (third): the edits before it and after it,
    two in all, can move it no further.
    """
    keys, own = [], []
    for d in range(MAX_EDITS + 1):
        n = size - d
        third = F.floor(n / 3).cast("int")
        rest = n - 3 * third
        second = third + (rest == 2).cast("int")
        last = third + (rest >= 1).cast("int")
        places = [(1, F.lit(0), third, True)]
        places += [(2, third + shift, second, shift == 0) for shift in range(d - 1, 2)]
        places += [(3, third + second + d, last, True)]
        for i, start, length, at_home in places:
            if d == 0 and at_home:
                own.append(len(keys))
            keys.append(F.xxhash64(F.lit(i), n, line.substr(start + 1, length)))
    return keys, own


def edit_distance(a: Column, b: Column, most: int = MAX_EDITS) -> Column:
    """The edit distance of a and b if it is `most` or less, else something larger.

    A band of 2 * most + 1 rows around the diagonal is held as bits: bit d of column j is row j - most + d. up and down
    are the rows where the distance rises or falls by one from the row above; `last` is the distance in the band's lowest row.
    """
    width, full = 2 * most + 1, (1 << (2 * most + 1)) - 1

    def over(x: Column) -> Column:
        a_chars, b_chars = x["a"], x["b"]

        def step(s: Column, c: Column) -> Column:
            match = sum((F.when(F.get(a_chars, s["j"] - most + d) == c, 1 << d).otherwise(0) for d in range(width)), F.lit(0))
            return let(F.struct(match.alias("m"), s.alias("s")), after)

        def after(t: Column) -> Column:
            up, down, m = t["s"]["up"], t["s"]["down"], t["m"]
            zero = (((m.bitwiseAND(up) + up).bitwiseXOR(up)).bitwiseOR(m).bitwiseOR(down)).bitwiseAND(F.lit(full))
            return let(F.struct(zero.alias("zero"), up.alias("up"), down.alias("down"), t["s"]["j"].alias("j"), t["s"]["last"].alias("last")), moved)

        def moved(t: Column) -> Column:
            zero, up, down = t["zero"], t["up"], t["down"]
            right = down.bitwiseOR(F.lit(full) - zero.bitwiseOR(up))
            left = zero.bitwiseAND(up)
            below = F.shiftright(zero, 1)
            return F.struct(
                (t["j"] + 1).alias("j"),
                left.bitwiseOR(F.lit(full) - below.bitwiseOR(right)).alias("up"),
                below.bitwiseAND(right).alias("down"),
                (t["last"] + 1 - F.shiftright(zero, width - 1)).alias("last"),
            )

        start = F.struct(F.lit(0).alias("j"), F.lit(full & ~((1 << most) - 1)).alias("up"), F.lit(0).alias("down"), F.lit(most).alias("last"))
        shift = F.size(a_chars) - F.size(b_chars) + most  # from this bit on, up to the last but one, rows lie below a's end

        def end(s: Column) -> Column:
            bits = sum((F.when(shift <= d, F.shiftright(s["up"], d).bitwiseAND(F.lit(1)) - F.shiftright(s["down"], d).bitwiseAND(F.lit(1))).otherwise(0) for d in range(width - 1)), F.lit(0))
            return s["last"] - bits

        return F.when((shift < 0) | (shift > 2 * most), F.lit(most + 1)).otherwise(let(F.aggregate(b_chars, start, step), end))

    chars = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))
    return let(F.struct(chars(a).alias("a"), chars(b).alias("b")), over)


def middles(a: Column, b: Column, steps: int = 32) -> Column:
    """a and b (a struct) without some of what they begin and end with alike; their distance stays the same."""

    def of(x: Column) -> Column:
        least = F.least(F.char_length(x["a"]), F.char_length(x["b"]))
        parts = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.floor(least * i / steps).cast("int"))
        return let(F.struct(x["a"].alias("a"), x["b"].alias("b"), least.alias("least"), parts.alias("parts")), front)

    def front(x: Column) -> Column:
        same = F.array_max(F.filter(x["parts"], lambda n: F.startswith(x["b"], x["a"].substr(F.lit(1), n))))
        return let(F.struct(x.alias("x"), same.alias("front")), back)

    def back(y: Column) -> Column:
        x = y["x"]
        same = F.array_max(F.filter(x["parts"], lambda n: F.endswith(x["b"], x["a"].substr(F.char_length(x["a"]) - n + 1, n))))
        return let(F.struct(x["a"].alias("a"), x["b"].alias("b"), y["front"].alias("front"), F.least(same, x["least"] - y["front"]).alias("back")), cut_off)

    def cut_off(y: Column) -> Column:
        return F.struct(*(y[c].substr(y["front"] + 1, F.char_length(y[c]) - y["front"] - y["back"]).alias(c) for c in "ab"))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def may_be_near(a: Column, b: Column, pieces: int, most: int = MAX_EDITS) -> Column:
    """What lines within `most` edits have in common: all but `most` of so many pieces of a stand in b, `most` characters from
    their place in a at the furthest. Cheap, and leaves the verification little to do."""

    def of(x: Column) -> Column:
        edge = lambda i: F.floor(x["size"] * i / pieces).cast("int")
        window = lambda i: x["b"].substr(F.greatest(edge(i) - most, F.lit(0)) + 1, edge(i + 1) + most - F.greatest(edge(i) - most, F.lit(0)))
        missing = F.filter(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: ~F.contains(window(i), x["a"].substr(edge(i) + 1, edge(i + 1) - edge(i))))
        return F.size(missing) <= most

    alike = F.abs(F.char_length(a) - F.char_length(b)) <= most
    return alike & let(F.struct(a.alias("a"), b.alias("b"), F.char_length(a).alias("size")), of)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly: the rows are few, what is done to each is costly."""
    sc = df.sparkSession.sparkContext
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), sc.defaultParallelism))


def may_share(a: Column, b: Column, most: int = MAX_EDITS) -> Column:
    """Whether lines of these bigram parities can be within `most` edits."""
    return F.bit_count(a.bitwiseXOR(b)) <= 4 * most


def few(df: DataFrame) -> DataFrame:
    """df (hashes and numbers), broadcast if it has BROADCAST_ROWS rows or fewer."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def distinct_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """h1, h2, doc (the least document that holds the line), size, k0, k1, ... for each distinct line of docs (doc, text); doc,
    n_lines for each document; the names of a line's own segments and of all keys.

    The keys are functions of the line, so their minimum over its copies is their value; all are longs, which a hash
    aggregate combines before the shuffle, however many copies there are. A document's count comes along as a row without
    a line (h1 is the document, h2 null), so the texts are read once.
    """
    rows = docs.select("doc", lines_of(F.col("text")).alias("ls"))
    rows = rows.select("doc", F.size("ls").alias("n"), F.explode(F.array_append("ls", F.lit(None).cast("string"))).alias("line")).withColumn("size", F.char_length("line"))
    made, own = segment_keys(F.col("line"), F.col("size"))  # of all lines: conditions would keep Spark from sharing subexpressions
    keys, is_line = [f"k{i}" for i in range(len(made))], F.col("line").isNotNull()
    h1, h2 = identity(F.col("line"))
    keyed = rows.select("doc", F.when(is_line, h1).otherwise(F.col("doc")).alias("h1"), F.when(is_line, h2).alias("h2"), F.when(~is_line, F.col("n")).alias("n"), "size", *(k.alias(c) for c, k in zip(keys, made, strict=True)))
    both = cut(keyed.groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.sum("n").alias("n_lines"), *(F.min(c).alias(c) for c in ("size", *keys))), "lines")
    return both.where("h2 IS NOT NULL").drop("n_lines"), both.where("h2 IS NULL").select("doc", "n_lines"), [keys[i] for i in own], keys


def bigram_parity(line: Column) -> Column:
    """64 bits, each the parity of the count of some pairs of neighbouring characters. An edit touches four pairs at most."""
    chars = F.split(line, "")
    bit = lambda c, i: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c, F.get(chars, i + 1)), F.lit(64)).cast("int"))
    return F.aggregate(F.transform(chars, bit), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


def listed(lines: DataFrame, keys: list[str]) -> DataFrame:
    """h1, key of the lines of LEAST_CHARS characters or more for some of their keys."""
    return lines.where(F.col("size") >= LEAST_CHARS).select("h1", F.explode(F.array(*keys)).alias("key"))


def fetched(docs: DataFrame, lines: DataFrame, some: DataFrame) -> DataFrame:
    """h1, h2, doc, pos, line of the lines in some (h1), each from the document where it stands first."""
    some = cut(lines.join(few(cut(some, "candidate-hashes")), "h1", "left_semi").select("h1", "h2", F.col("doc").alias("at")), "candidate-lines")
    placed = docs.join(few(some.select(F.col("at").alias("doc")).distinct()), "doc", "left_semi").select("doc", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    placed = placed.select("doc", "pos", "line", *identity(F.col("line"))).join(few(some), ["h1", "h2"]).where("doc = at")
    return cut(placed.groupBy("h1", "h2", "doc").agg(F.min("pos").alias("pos"), F.min("line").alias("line")), "candidate-texts")


def near(a: Column, b: Column) -> Column:
    """Whether two lines are within MAX_EDITS edits; the cheaper conditions come first."""
    distance = let(middles(a, b), lambda m: edit_distance(m["a"], m["b"]))
    return may_be_near(a, b, PIECES[0]) & may_be_near(a, b, PIECES[1]) & (distance <= MAX_EDITS)


def later_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """h1, h2 of the later line of each of pairs (a, b: h1) that are near; written."""
    side = lambda n: texts.select(F.col("h1").alias(n), F.struct("doc", "pos", "h2").alias(f"{n}_at"), F.col("line").alias(f"{n}_line"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(near(F.col("a_line"), F.col("b_line")))
    later = F.when(F.col("a_at") < F.col("b_at"), F.struct(F.col("b").alias("h1"), "b_at.h2")).otherwise(F.struct(F.col("a").alias("h1"), "a_at.h2"))
    return cut(close.select(later.alias("l")).select("l.*").distinct(), "near")


def near_copies(docs: DataFrame, lines: DataFrame, own: list[str], keys: list[str]) -> DataFrame:
    """h1, h2 of the lines that have a near one at an earlier place: in a document of a smaller id, or before them in their own."""
    stored, asked = listed(lines, own), listed(lines, keys)
    crowded = few(cut(stored.groupBy("key").count().where(F.col("count") > CROWD).select("key"), "crowded"))
    x, y = stored.select(F.col("h1").alias("x"), "key"), asked.select(F.col("h1").alias("y"), "key")
    pairs = x.join(crowded, "key", "left_anti").join(y, "key").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = cut(pairs.distinct(), "candidates")
    sides = [cut(side.join(crowded, "key", "left_semi"), "crowds") for side in (stored, asked)]
    of_crowds = sides[0].union(sides[1]).select("h1").distinct()
    texts = fetched(docs, lines, pairs.select(F.col("a").alias("h1")).union(pairs.select(F.col("b").alias("h1"))).union(of_crowds).distinct())
    found = later_of(pairs, texts)
    if not sides[0].isEmpty():
        found = near_in_crowds(sides, texts, of_crowds, found)
    return found.distinct()


def near_in_crowds(sides: list[DataFrame], texts: DataFrame, of_crowds: DataFrame, found: DataFrame) -> DataFrame:
    """h1, h2 of the lines with an earlier witness among those under one key, and those in found.

    sides: h1, key of the stored lines and of the asking ones. A line meets the other side's earliest line of each part of
    a key (parts by hash), in the last round all of them. Pairs are compared inside the join, so only near ones leave it."""
    about = spread(texts.join(of_crowds, "h1", "left_semi")).select("h1", F.struct("doc", "pos", "h2").alias("at"), bigram_parity(F.col("line")).alias("parity"), "line")
    about = cut(about, "crowd-lines")
    sides = [cut(side.join(about, "h1"), "members") for side in sides]
    most = max(side.groupBy("key").count().agg(F.max("count")).first()[0] or 0 for side in sides)
    parts = 1
    while True:
        met = [witnessed(needing.join(found, "h1", "left_anti"), other, parts if parts < most else None) for needing, other in (sides, sides[::-1])]
        found = found.union(cut(met[0].union(met[1]).distinct(), "near"))
        if parts >= most:
            return found
        parts *= GROWTH


def witnessed(needing: DataFrame, other: DataFrame, parts: int | None) -> DataFrame:
    """h1, h2 of the lines in needing that are near an earlier one of other under their key: the earliest one of each of so many
    parts, or any. Both: h1, key, at, parity, line. Lines that need a witness are dealt out, TOGETHER to a task."""
    there = other.select("key", F.struct("at", "h1", "parity", "line").alias("w"))
    if parts is not None:
        there = there.groupBy("key", F.pmod(F.xxhash64("w.h1"), F.lit(parts))).agg(F.min("w").alias("w"))
    sizes = needing.groupBy("key").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("slots"))
    needing = needing.join(sizes, "key").withColumn("slot", F.pmod(F.xxhash64("h1"), F.col("slots")).cast("int"))
    there = there.join(sizes, "key").select(F.col("key").alias("of"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("w_slot"), "w")
    fits = (F.col("key") == F.col("of")) & (F.col("slot") == F.col("w_slot")) & (F.col("w.at") < F.col("at")) & may_share(F.col("parity"), F.col("w.parity"))
    return needing.join(there, fits & near(F.col("line"), F.col("w.line"))).select("h1", "at.h2")


def first_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc, h1, near for each distinct line: the document where it stands first, and whether an earlier line is near it; and
    doc, n_lines for each document. docs: doc, text."""
    lines, sizes, own, keys = distinct_lines(docs)
    found = few(cut(near_copies(docs, lines, own, keys), "near"))
    return lines.select("doc", "h1", "h2").join(found.withColumn("near", F.lit(True)), ["h1", "h2"], "left").withColumn("near", F.col("near").isNotNull()), sizes


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines (with a letter or digit in them), n_exact and n_near (how many of them go), one row for each id.

    A line goes if it equals one at an earlier place (n_exact), or if it is the first of its kind but near one at an earlier
    place (n_near): both of LEAST_CHARS characters or more and within MAX_EDITS edits. Places are ordered by id, then by
    position; rows that share an id are one document here, and rows of a null id count as one last document. Null and empty
    texts have no lines; an empty table gives no rows.
    """
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.col(text_col).alias("text"))
    first, sizes = first_lines(docs)
    first = first.groupBy("doc").agg(F.count("*").alias("n_first"), F.sum(F.col("near").cast("long")).alias("n_near"))
    out = sizes.join(first, "doc", "left").na.fill(0, ["n_first", "n_near"])
    doc_id = F.when(F.col("doc") != LAST, F.col("doc")).alias(id_col)
    return out.select(doc_id, "n_lines", (F.col("n_lines") - F.col("n_first")).alias("n_exact"), "n_near")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that go taken out of their texts (and n_chars, if there, counted again); all rows stay.

    Lines without a letter or digit stay. A line that stays does so at its first place in each row of its document. Rows of
    a null id are documents of their own here, ordered by a hash of their text among ids from 2 ** 62 on."""
    alone = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    doc = F.coalesce(F.col(id_col).cast("long"), alone)
    first, _ = first_lines(docs.select(doc.alias("doc"), F.col(text_col).alias("text")))
    stays = first.where("NOT near").groupBy(F.col("doc").alias("__doc")).agg(F.collect_list("h1").alias("__stays"))
    names = docs.columns
    joined = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"), doc.alias("__doc"), F.col(text_col).alias("__text")).join(stays, "__doc", "left")

    stay = F.coalesce(F.col("__stays"), F.array().cast("array<long>"))

    def entry(x: Column, i: Column) -> Column:
        whole = F.btrim(x, F.lit(BLANKS))
        return F.struct(F.when(has_word(whole), F.xxhash64(whole)).alias("h"), F.lit(1).alias("line"), i.alias("pos"))

    def kept(lines: Column) -> Column:
        return let(F.transform(lines, entry), lambda e: let(in_order(e), lambda s: let(F.struct(lines.alias("lines"), e.alias("e"), s.alias("s")), pick)))

    def in_order(entries: Column) -> Column:
        """A hash that stays comes right before the lines that have it, these by position."""
        marks = F.transform(stay, lambda h: F.struct(h.alias("h"), F.lit(0).alias("line"), F.lit(-1).alias("pos")))
        return F.sort_array(F.concat(F.filter(entries, lambda x: x["h"].isNotNull()), marks))

    def pick(t: Column) -> Column:
        before = lambda i: F.get(t["s"], i - 1)
        long = F.filter(t["s"], lambda x, i: (x["line"] == 1) & (before(i)["line"] == 0) & (before(i)["h"] == x["h"]))
        places = F.concat(long, F.filter(t["e"], lambda x: x["h"].isNull()))
        return F.transform(F.sort_array(F.transform(places, lambda x: x["pos"])), lambda i: F.get(t["lines"], i))

    text = F.when(F.col("__text").isNotNull(), F.array_join(let(F.split("__text", "\n"), kept), "\n"))
    row = lambda c: F.col("__row").getField(c)
    out = joined.select("__row", text.alias("__text"))
    fresh = {text_col: F.col("__text"), "n_chars": F.char_length("__text").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    return out.select(*((fresh[c] if c in fresh else row(c)).alias(c) for c in names))


#: DuckDB. Its levenshtein() counts bytes, so letters beyond ASCII are first written as a control character each.
SQL = r"""
WITH l AS (
  SELECT doc_id, pos, trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[\p{L}\p{N}]')),
c AS (SELECT array_to_string(list_transform(list_filter(range(1, 32), lambda x: x NOT BETWEEN 9 AND 13), lambda x: chr(CAST(x AS INTEGER))), '') AS controls),
f AS (
  SELECT line, min((doc_id, pos)) AS place, length(line) AS n, any_value(translate(line, 'äöüßéèêçñóáíúÄÖÜÉÈÊÇÑÓÁÍÚ', controls)) AS bytes
  FROM w, c GROUP BY line),
near AS (
  SELECT DISTINCT b.line FROM f a JOIN f b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.place < b.place
  WHERE a.n >= 30 AND b.n >= 30 AND levenshtein(a.bytes, b.bytes) <= 2),
kept AS (SELECT place[1] AS doc_id, count(*) AS n_first, count(near.line) AS n_near FROM f LEFT JOIN near ON near.line = f.line GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_lines FROM w GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_lines, 0) - coalesce(n_first, 0) AS BIGINT) AS n_exact,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
