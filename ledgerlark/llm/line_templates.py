"""Line dedup by a log-template tree, in DataFrame operations only.

A line's digits are masked; the tree's path is its token count and its LEADING leading tokens, those with digits as <*>.
In a leaf that lines of MIN_DOCS texts reach, a token stays if MIN_DOCS texts have it at its position, any other one is a variable
field <*>; what results is the line's template. A template recurs if MIN_DOCS different texts have a line of it and
enough of its tokens are fixed (FIXED_SHARE, and FIXED_TOKENS of them; a line without variable fields needs neither). Lines
of recurring templates are dropped, whatever share of a document they are.

With ``by_groups`` (the pipeline's way) lines that only near copies share are left to near-duplicate removal: texts that are recurring
lines for the most part (over COPY_SHARE of their characters) are compared by their lines, and a line counts once for each group of copies. A long line
(LONG_WORDS or LONG_CHARS) that two such groups have as it is stays in the group with the smallest doc_id and goes from the others.

All counts are of distinct texts, so exact copies count once. Lines move as hashes with their numbers; distinct masked lines stand
for all their occurrences, so a line that a third of the documents have is one row in the tree.

Defined results: a null text stays null and an empty one empty; blank lines stay; repeated rows give equal results; line
order and line ends (\\n) stay; an empty table gives an empty result; other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import hot_lookup, read_table, stored

MIN_DOCS = 5
LEADING = 3
FIXED_SHARE = 0.7
FIXED_TOKENS = 4
COPY_SHARE = 0.5
SAME_LINES = 0.6
#: Lines of so many words, or characters where words aren't spaced, recur from two groups of texts on.
LONG_WORDS = 25
LONG_CHARS = 200
#: Bits of the bitmap of populous leaves, a power of two: at most BITMAP_BITS / 64 rows are broadcast.
BITMAP_BITS = 1 << 22


def _masked(line: Column) -> Column:
    return F.regexp_replace(F.trim(line), "[0-9]+", "0")


def _leaf(masked: Column) -> Column:
    tokens = F.length(masked) - F.length(F.replace(masked, F.lit(" "))) + 1
    # Tried at the starts of tokens only, so that a long token costs no more than its length.
    lead = F.regexp_replace(F.substring_index(masked, " ", LEADING), "(?<![^ ])[^ ]*?0[^ ]*", "<*>")
    return F.concat_ws(" ", tokens.cast("string"), lead)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, doc (the text's hash), at, masked, size, key and leaf of each line that isn't blank."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("doc"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.select("doc_id", "doc", "at", _masked(F.col("line")).alias("masked"), F.length("line").alias("size"), F.trim("line").alias("line")).filter("masked <> ''")
    return lines.withColumns({"key": F.xxhash64("masked"), "leaf": F.xxhash64(_leaf(F.col("masked")))})


def _exact(lines: DataFrame) -> DataFrame:
    """lines with exact, a hash of the line with its digits where it is long, else null."""
    long = (F.col("size") >= LONG_CHARS) | (F.size(F.split("masked", " +")) >= LONG_WORDS)
    return lines.withColumn("exact", F.when(long, F.xxhash64("line")))


def _bits(values: Column) -> tuple[Column, Column]:
    """Cell and bit of a hash in a bitmap of BITMAP_BITS bits."""
    place = values.bitwiseAND(F.lit(BITMAP_BITS - 1))
    return F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")


def recurring_lines(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """key, template and lines: the masked lines of recurring templates, and how many rows of ``lines`` have them.

    lines (key, leaf, doc) has no text. texts (key, leaf, masked) are the same lines with it, of which only those in leaves
    that enough texts reach are shuffled: a bitmap of these leaves, of a fixed size, keeps the others out.
    """
    return recurring_pairs(line_pairs(lines), texts, lines.count())


def line_pairs(lines: DataFrame) -> DataFrame:
    """key, doc, n and leaf: the distinct masked lines of each text and how many rows of ``lines`` they are."""
    return stored(lines.groupBy("key", "doc").agg(F.count(F.lit(1)).alias("n"), F.first("leaf").alias("leaf")), "line-pairs")


def recurring_pairs(pairs: DataFrame, texts: DataFrame, total: int) -> DataFrame:
    """As recurring_lines, of pairs whose n add up to ``total``; doc is a text or a group of texts."""
    distinct = stored(pairs.groupBy("key").agg(F.first("leaf").alias("leaf"), F.count(F.lit(1)).alias("docs"), F.sum("n").alias("lines")), "line-distinct")
    leaves = distinct.groupBy("leaf").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("members")).filter(F.col("docs") >= MIN_DOCS)
    leaves = stored(leaves.select("leaf", "members", F.lit(1).alias("_is")), "line-leaves")
    members = hot_lookup(distinct.select("key", "docs", "leaf"), leaves, "leaf", "members", total).filter("_is = 1")
    members = stored(members.select("key", "docs", "leaf"), "line-members")
    cell, bit = _bits(F.col("leaf"))
    bitmap = stored(leaves.select(cell.alias("_cell"), bit.alias("_bit")).groupBy("_cell").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")), "line-bitmap")
    likely = texts.withColumns({"_cell": cell, "_bit": bit}).join(F.broadcast(bitmap), "_cell").filter(F.expr("shiftright(_bits, _bit) & 1 = 1"))
    likely = likely.groupBy("key").agg(F.first("masked").alias("masked"))
    members = stored(members.join(likely, "key"), "line-member-texts")
    tokens = members.select("key", "docs", "leaf", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    tokens = stored(tokens.withColumn("cell", F.xxhash64("leaf", "at", "token")), "line-tokens")
    cells = tokens.groupBy("cell").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("rows"))
    fixed = stored(cells.filter(F.col("docs") >= MIN_DOCS).select("cell", "rows", F.lit(1).alias("_fixed")), "line-cells")
    known = hot_lookup(tokens.select("key", "at", "token", "cell"), fixed, "cell", "rows", tokens.count())
    stays = F.col("_fixed").isNotNull() & ~F.contains("token", F.lit("0"))
    parts = known.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("at", F.when(stays, F.col("token")).otherwise("<*>").alias("token")))).alias("parts"),
        F.count_if(stays).alias("fixed"),
        F.count(F.lit(1)).alias("all"),
    )
    templates = parts.select("key", F.array_join(F.transform("parts", lambda p: p["token"]), " ").alias("template"), "fixed", "all")
    general = (F.col("fixed") >= FIXED_TOKENS) & (F.col("fixed") >= FIXED_SHARE * F.col("all")) | (F.col("fixed") == F.col("all"))
    templates = stored(templates.filter(general).join(distinct.select("key", "lines", "docs"), "key"), "line-templates")
    by_doc = hot_lookup(pairs.select("key", "doc"), templates.select("key", "docs", F.xxhash64("template").alias("template")), "key", "docs", total)
    by_doc = by_doc.filter("template IS NOT NULL").groupBy("template", "doc").agg(F.lit(1).alias("one"))
    often = by_doc.groupBy("template").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= MIN_DOCS)
    # A line that often recurs as it is needs no template.
    same = distinct.filter(F.col("docs") >= MIN_DOCS).select("key", F.lit(None).cast("string").alias("template"), "lines")
    rest = templates.join(stored(often.select(F.col("template").alias("_t")), "line-often"), F.xxhash64("template") == F.col("_t"), "left_semi").select("key", "template", "lines")
    return same.unionByName(rest.join(same.select("key"), "key", "left_anti"))


def copy_groups(lines: DataFrame, suspects: DataFrame) -> DataFrame:
    """doc and group: of the texts (hashes) in ``suspects`` those that are copies of another by their lines.

    A line's owner is the least text that has it. A text is a copy of the owner of most of its characters if what they share is SAME_LINES
    of all their lines' characters together; owners are in their own groups. Pairs of texts aren't made.
    """
    own = lines.join(suspects, "doc", "left_semi").groupBy("doc", "key").agg(F.first("size").alias("size"))
    own = stored(own, "line-suspect-lines")
    sizes = stored(own.groupBy("doc").agg(F.sum("size").alias("whole")), "line-suspect-sizes")
    owners = own.groupBy("key").agg(F.min("doc").alias("owner"), F.count(F.lit(1)).alias("docs")).filter("docs > 1")
    met = hot_lookup(own, owners, "key", "docs", own.count()).filter("owner IS NOT NULL")
    shared = met.groupBy("doc", "owner").agg(F.sum("size").alias("same"))
    best = shared.groupBy("doc").agg(F.max_by(F.struct("owner", "same"), F.struct("same", "owner")).alias("b")).select("doc", "b.owner", "b.same")
    best = stored(best.join(sizes, "doc"), "line-suspect-owners")
    of_owner = best.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).join(sizes.select(F.col("doc").alias("owner"), F.col("whole").alias("owner_whole")), "owner")
    found = hot_lookup(best, of_owner, "owner", "n", best.count())
    return found.filter(F.col("same") >= SAME_LINES * (F.col("whole") + F.col("owner_whole") - F.col("same"))).select("doc", F.col("owner").alias("group"))


def shared_long_lines(places: DataFrame) -> DataFrame:
    """exact, doc, n and first (the least of its rows' doc_ids, null ones last) of each text with a long line that another text has."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    pairs = stored(places.groupBy("exact", "doc").agg(F.count(F.lit(1)).alias("n"), first.alias("first")), "line-long")
    often = pairs.groupBy("exact").agg(F.count(F.lit(1)).alias("docs"), F.lit(1).alias("_is")).filter("docs > 1")
    return stored(hot_lookup(pairs, often, "exact", "docs", pairs.count()).filter("_is = 1").drop("_is"), "line-long-shared")


def repeated_long_lines(places: DataFrame, shared: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``places`` whose line two groups have, but for those of the group that keeps it."""
    grouped = shared.join(groups, "doc", "left").withColumn("group", F.coalesce("group", "doc"))
    grouped = grouped.groupBy("exact", "group").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    owners = grouped.groupBy("exact").agg(F.min_by("group", F.struct("first", "group")).alias("owner"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
    owners = stored(owners.filter("groups > 1").drop("groups"), "line-owners")
    total = places.count()
    met = stored(hot_lookup(places, owners, "exact", "n", total).filter("owner IS NOT NULL"), "line-long-places")
    rows = met.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).join(groups, "doc")
    return hot_lookup(met, rows, "doc", "n", met.count()).filter(F.coalesce("group", "doc") != F.col("owner")).select("doc_id", "doc", "at", "size")


def _per_doc(hit: DataFrame) -> DataFrame:
    # Repeated rows have one place in the result, so a place counts once.
    per_doc = hit.groupBy("doc_id", "doc", "at").agg(F.first("size").alias("size")).groupBy("doc_id", "doc").agg(F.collect_list("at").alias("_at"), F.sum("size").alias("_size"))
    return per_doc.select(F.col("doc_id").alias("_id"), F.col("doc").alias("_doc"), "_at", "_size")


def dedup_lines(docs: DataFrame, by_groups: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) with the remaining text, n_lines and n_dropped; columns of other names as they are."""
    texts = _lines(docs)
    lines = stored((_exact(texts) if by_groups else texts).drop("masked", "line"), "lines")
    total, pairs, masked = lines.count(), line_pairs(lines.select("key", "leaf", "doc")), texts.select("key", "leaf", "masked")

    def hits(pairs: DataFrame) -> DataFrame:
        found = stored(recurring_pairs(pairs, masked, total).select("key", "lines", F.lit(1).alias("_is")), "line-recurring")
        return hot_lookup(lines.select("doc_id", "doc", "at", "size", "key"), found, "key", "lines", total).filter("_is = 1")

    per_doc = stored(_per_doc(hits(pairs)), "line-hits")
    if by_groups:
        # Of a text, not of its rows: a text that many rows have is one suspect.
        sizes = lines.groupBy("doc_id", "doc", "at").agg(F.first("size").alias("size")).groupBy("doc_id", "doc").agg(F.sum("size").alias("_whole"))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc") == F.col("_doc"))
        suspects = sizes.join(per_doc, same).filter(F.col("_size") > COPY_SHARE * F.col("_whole")).select("doc")
        long = lines.filter("exact IS NOT NULL").select("doc_id", "doc", "at", "size", "exact")
        shared = shared_long_lines(long)
        suspects = stored(suspects.union(shared.select("doc")).distinct(), "line-suspects")
        groups = stored(copy_groups(lines.select("doc", "key", "size"), suspects), "line-copies")
        grouped = pairs.join(groups, "doc", "left").withColumn("doc", F.coalesce("group", "doc"))
        grouped = grouped.groupBy("key", "doc").agg(F.sum("n").alias("n"), F.first("leaf").alias("leaf"))
        hit = hits(stored(grouped, "line-group-pairs")).select("doc_id", "doc", "at", "size")
        per_doc = stored(_per_doc(hit.union(repeated_long_lines(long, shared, groups))), "line-group-hits")
    # The row is kept in one column, so that its own columns may have any names.
    rows = docs.select("doc_id", "text", F.struct("*").alias("_row"))
    boiled = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_doc")), "left").withColumnRenamed("_at", "_drop")
    parts = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_drop")
    # The lines are one value inside the outer function, split once and then taken by number.
    kept = F.transform(F.array(parts), lambda lines: F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))[0]
    text = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(kept)
    new = F.struct(text.alias("text"), F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))
    out = boiled.select("_row", new.alias("_new"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*[F.col("_new" if c == "text" else "_row")[c].alias(c) for c in columns], F.col("_new")["n_lines"].alias("n_lines"), F.col("_new")["n_dropped"].alias("n_dropped"))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
m AS (SELECT doc_id, text, pos, line, regexp_replace(trim(line, ' '), '[0-9]+', '0', 'g') AS masked FROM l),
d AS (SELECT masked, count(DISTINCT text) AS docs,
        concat_ws(' ', CAST(length(masked) - length(replace(masked, ' ', '')) + 1 AS VARCHAR),
          regexp_replace(array_to_string(string_split(masked, ' ')[1:3], ' '), '[^ ]*0[^ ]*', '<*>', 'g')) AS leaf
      FROM m WHERE masked <> '' GROUP BY masked),
f AS (SELECT leaf FROM d GROUP BY leaf HAVING sum(docs) >= 5),
t AS (SELECT d.masked, d.docs, d.leaf, unnest(string_split(d.masked, ' ')) AS token, generate_subscripts(string_split(d.masked, ' '), 1) AS pos
      FROM d JOIN f USING (leaf)),
c AS (SELECT leaf, pos, token FROM t GROUP BY leaf, pos, token HAVING sum(docs) >= 5),
p AS (SELECT t.masked, string_agg(CASE WHEN c.token IS NOT NULL AND NOT contains(t.token, '0') THEN t.token ELSE '<*>' END, ' ' ORDER BY t.pos) AS template,
        count(CASE WHEN c.token IS NOT NULL AND NOT contains(t.token, '0') THEN 1 END) AS fixed, count(*) AS total
      FROM t LEFT JOIN c ON c.leaf = t.leaf AND c.pos = t.pos AND c.token = t.token GROUP BY t.masked, t.leaf),
g AS (SELECT masked, template FROM p WHERE fixed >= 4 AND fixed >= 0.7 * total OR fixed = total),
o AS (SELECT template FROM g JOIN m USING (masked) GROUP BY template HAVING count(DISTINCT text) >= 5),
r AS (SELECT masked FROM d WHERE docs >= 5 UNION SELECT masked FROM g WHERE template IN (SELECT template FROM o)),
h AS (SELECT doc_id, list(pos) AS ats FROM m JOIN r USING (masked) GROUP BY doc_id),
x AS (SELECT doc_id, text, h.ats FROM documents LEFT JOIN h USING (doc_id))
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ats), 0) AS BIGINT) AS n_dropped,
  md5(CASE WHEN ats IS NULL THEN text ELSE coalesce((SELECT string_agg(line, chr(10) ORDER BY pos) FROM m WHERE m.doc_id = x.doc_id AND NOT list_contains(x.ats, m.pos)), '') END) AS text_md5
FROM x
"""
