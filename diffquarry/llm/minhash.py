"""Near-duplicate text units by MinHash banding, exact verification and union-find; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_parts, discard, free_shuffles, materialize
from .components import components

#: Rows at most of a table of ids, places or roots that is sent to all executors; beyond, both sides of its join are shuffled.
BROADCAST_ROWS = 1 << 20
#: One unit in so many is looked at to find hot buckets, and members there that make a bucket hot.
SAMPLE, HOT = 64, 64
#: Members of a bucket up to which all that aren't connected meet.
SMALL = 16
#: Hot buckets at most, by their size in the sample; parts that a hot bucket is dealt out to.
MOST_HOT, PARTS = 10_000, 64


def tune(threshold: float, rows: int, recall: float) -> int:
    """Values of a signature such that pairs of that similarity have a band in common with that probability at least.

    A shingle of either set is in both with probability threshold, so a pair has no common band if no rows in a row of the
    least shingles of both are.
    """
    without, values = [1.0] * rows, rows - 1
    while 1 - without[-1] < recall:
        without.append(sum((1 - threshold) * threshold**i * without[-1 - i] for i in range(rows)))
        values += 1
    return values


def tune_spread(threshold: float, rows: int, recall: float) -> int:
    """Values for band_keys such that pairs of that similarity have a key in common with that probability at least: those of
    tune, or as many as give parts enough, each of which has its key in common with probability threshold ** rows."""
    values, missed = tune(threshold, rows, recall), 1 - threshold**rows
    while missed ** ((values + 1) // 2) > 1 - recall:
        values += 1
    return values


def _sent(written: DataFrame) -> DataFrame:
    """A written table, sent to all executors where it is joined if it is small enough."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def character_hashes(text: Column, width: int) -> Column:
    """Hashes of all runs of width characters, repeats included; a shorter text is one shingle.

    In UTF-32 all characters have four bytes, so that a run is a slice at a known place.
    """
    size = 4 * width

    def runs(b):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(b) - size + 1), F.lit(4)), lambda i: F.xxhash64(F.substring(b, i, F.lit(size))))

    return _with(F.encode(text, "UTF-32"), runs)


def word_hashes(text: Column, width: int) -> Column:
    """Hashes of all runs of width words of a text with single spaces; a shorter text is one shingle."""

    def runs(words):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - width + 1)), lambda i: F.xxhash64(F.slice(words, i, F.least(F.lit(width), F.size(words)))))

    return _with(F.transform(F.split(text, " "), lambda w: F.xxhash64(w)), runs)


#: First characters of the shingles by which long texts are signed, about one in eight of Latin text.
ANCHORS = "dgkopuwz57éö"
#: Distinct anchored shingles that a text must have to be signed by them; up to twice as many it is signed by all, too.
ANCHORED = 8


def anchored_hashes(text: Column, width: int) -> Column:
    """Hashes of the runs of width characters that begin with an anchor, a sample that depends on each run alone."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)(?=([{ANCHORS}].{{{width - 1}}}))"), F.lit(1)), lambda x: F.xxhash64(x))


def sampled_keys(units: DataFrame, width: int, values: int, rows: int) -> DataFrame:
    """(id, n, band) of units (id, n, text): band_keys of all character shingles for short texts, of the anchored ones for
    long, of both in between.

    So the cost of a long text is mostly one search for anchors. Texts without anchors, in other scripts, are signed by all.
    What is sorted stands outside of higher-order functions, which Spark doesn't compile; each select is a step whose
    columns are worked out once.
    """
    few = F.sort_array(F.array_distinct(anchored_hashes(F.col("text"), width)))
    size, none = F.size("few"), F.array().cast("array<bigint>")
    found = units.select("id", "n", "text", few.alias("few"))
    found = found.select("id", "n", "few", F.when(size < 2 * ANCHORED, F.sort_array(F.array_distinct(character_hashes(F.col("text"), width)))).otherwise(none).alias("all"))
    of_all = F.when(size < 2 * ANCHORED, sorted_keys(F.col("all"), values, rows)).otherwise(none)
    of_few = F.when(size >= ANCHORED, sorted_keys(F.col("few"), values, rows)).otherwise(none)
    return found.select("id", "n", F.explode(F.concat(of_all, of_few)).alias("band"))


def sorted_keys(v: Column, values: int, rows: int) -> Column:
    """band_keys of a sorted set of hashes."""
    bits = ((values + 1) // 2 - 1).bit_length()

    def new(v, i, bits):
        return (i == 0) | (F.shiftright(F.get(v, i), 64 - bits) != F.shiftright(F.get(v, i - 1), 64 - bits))

    def starts(v):
        every, room = F.sequence(F.lit(0), F.size(v) - 1), F.size(v) < rows << bits
        return F.when(room, F.filter(every, lambda i: new(v, i, bits + 1))).otherwise(F.filter(every, lambda i: new(v, i, bits)))

    def keys(v):
        first, w = F.when(F.size(v) > values, starts(v)).otherwise(F.transform(v, lambda _, i: i)), F.concat(v, F.slice(v, 1, rows))
        return _with(w, lambda w: F.transform(first, lambda i: F.xxhash64(F.slice(w, i + 1, F.least(F.lit(rows), F.size(v))))))

    return _with(v, keys)


def band_keys(hashes: Column, values: int, rows: int) -> Column:
    """Keys under which a unit meets others, each made of rows neighbours in the order of hashes, around the end.

    The range of hashes is parted evenly, into the next power of two of half of values. A set has the key of the first hash
    of each part and those that follow, so rows hashes that follow a part's start are those of both sets if the first rows of
    their union are common, and other parts are met by other hashes: half as many keys find what all neighbours
    among the values least hashes find. Sets of fewer hashes than rows for each part take twice as many parts, and those of at most values
    hashes all neighbours; so any two sets have the starts of parts in common. In the smallest sets a differing shingle
    spoils rows keys at most, so pairs at the threshold all meet if rows * (1 - threshold) < 1. Repeated hashes
    count once: equal sets have equal keys.
    """
    return sorted_keys(F.sort_array(F.array_distinct(hashes)), values, rows)


def _pivots(keyed: DataFrame) -> DataFrame:
    """keyed (id, n, band) with pivot, the most frequent unit of each band, and large, whether it has more than SMALL
    members; bands of one member go.

    Bands that many units of a sample share are dealt out to parts, of which the pivots of the whole band are put
    together by partial sums; so no task holds a hot bucket.
    """
    sample = keyed.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).groupBy("band").agg(F.count(F.lit(1)).alias("__n"))
    hot = materialize(sample.filter(F.col("__n") >= HOT).orderBy(F.desc("__n"), "band").limit(MOST_HOT).select("band", F.lit(True).alias("hot")), "hot")
    by, crowded = ["band"], not hot.isEmpty()
    if crowded:
        keyed = keyed.join(F.broadcast(hot), "band", "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(PARTS))).otherwise(F.lit(0)))
        by = ["band", "part"]
    dealt = keyed.repartition(*by)  # one shuffle that is read twice, whole rows each time: for the sizes of buckets, then for the members of those of several
    several = [F.count(F.lit(1)).alias("size"), F.min("id").alias("least"), F.max("n").alias("most")] + ([F.max("hot").alias("__hot")] if crowded else [])
    several = dealt.groupBy(*by).agg(*several).filter("size > 1 or __hot" if crowded else "size > 1").select(*by, "size", "most", "least")
    members = dealt.join(several.hint("shuffle_hash"), by)
    members = members.withColumn("pivot", F.coalesce(F.min(F.when(F.col("n") == F.col("most"), F.col("id"))).over(Window.partitionBy(*by)), "least"))
    if not crowded:
        return materialize(members.select("band", "id", "n", "pivot", (F.col("size") > SMALL).alias("large")), "buckets")
    members = materialize(members.select("band", "id", "n", "pivot", "hot", (F.col("hot").isNotNull() | (F.col("size") > SMALL)).alias("large")), "members")
    whole = members.filter("hot").groupBy("band").agg((-F.max(F.struct("n", (-F.col("id")).alias("id")))["id"]).alias("of_all"))
    made = materialize(members.join(F.broadcast(whole), "band", "left").select("band", "id", "n", F.coalesce("of_all", "pivot").alias("pivot"), "large"), "buckets")
    discard(members)
    return made


#: What a comparison adds to a pair.
COMPARED = {"apart": "double", "near": "boolean", "size": "int", "length": "int", "own": "array<bigint>", "common": "array<bigint>"}


def _compared(pairs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], hashes: Callable[[Column], Column], threshold: float) -> DataFrame:
    """pairs (a, b, large) with apart, their Jaccard distance, and near, whether they reach threshold.

    For large ones also size, the number of shingles of a; length, that of its prefix (see _rest); own, the shingles that
    b lacks; and common, as many shingles of both, by hash, as the prefix has room for.
    """
    pairs = materialize(pairs, "pairs")
    if pairs.isEmpty():
        return pairs.select("a", "b", "large", *[F.lit(None).cast(kind).alias(name) for name, kind in COMPARED.items()])
    texts = materialize(texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()), "texts", "zstd")
    second = texts.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_semi").repartition("id").select(F.col("id").alias("b"), F.array_distinct(hashes(F.col("text"))).alias("y"))  # pivots are hashed once, where their pairs are
    met = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "x"}), "a").join(second, "b")
    sets = met.select("a", "b", "large", F.array_distinct(hashes(F.col("x"))).alias("x"), "y")
    sets = sets.withColumn("both", F.array_intersect("x", "y")).withColumn("size", F.size("x"))
    common = F.size("both")
    jaccard = common / (F.col("size") + F.size("y") - common)
    length = F.col("size") - F.ceil(F.round(threshold * F.col("size"), 9)).cast("int") + 1
    own = F.when(F.col("large"), F.array_except("x", "both"))
    room = F.when(F.col("large"), F.slice(F.sort_array("both"), F.lit(1), F.greatest(F.lit(0), length - F.col("size") + common)))
    made = materialize(sets.select("a", "b", "large", (1 - jaccard).alias("apart"), (jaccard >= threshold).alias("near"), "size", length.alias("length"), own.alias("own"), room.alias("common")), "compared")
    discard(pairs, texts)
    free_shuffles(made.sparkSession)
    return made


def _rest(members: DataFrame, first: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of units of one bucket that aren't connected, haven't met, and may reach threshold.

    Jaccard distance is a metric, so two units can be near only if they are about as far from their pivot as each other.
    In small buckets all such pairs meet. In large ones a prefix filter comes first: the shingles of a pivot's units are
    ordered by rarity, those of the pivot itself last. Two sets can't reach the threshold unless they share one among
    their first size - ceil(threshold * size) + 1, at ranks that leave room for the overlap they need. Edits are rare, so
    variants of a pivot that differ from each other seldom do. Lists whose units are all connected go at once; in others
    the units of the largest component meet the others only.
    """
    far, slack = 1 - threshold + 1e-9, 1 - threshold
    roots = _sent(roots)
    rooted = first.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    rooted = rooted.join(roots.select(F.col("node").alias("b"), F.col("root").alias("of_pivot")), "b", "left").withColumn("of_pivot", F.coalesce("of_pivot", "b"))
    rooted = materialize(rooted, "rooted")

    small = members.filter("not large and id <> pivot").join(rooted.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "root", "apart"), ["id", "pivot"]).select("band", "id", "root", "apart")
    other = small.withColumnsRenamed({"id": "y", "root": "of_y", "apart": "y_apart"})
    met = small.join(other, "band").filter((F.col("id") > F.col("y")) & (F.col("root") != F.col("of_y")) & (F.abs(F.col("apart") - F.col("y_apart")) <= far))
    few = met.select(F.col("id").alias("a"), F.col("y").alias("b")).distinct()

    wide = rooted.filter("large")
    mixed = wide.filter("root <> of_pivot").groupBy("b").agg(F.min("apart").alias("nearest"))
    wide = wide.join(mixed, "b").filter((F.col("root") != F.col("of_pivot")) | (F.col("apart") >= F.col("nearest") - slack - 1e-9))
    alone = wide.groupBy("b").agg((F.min("root") == F.max("root")).alias("alone")).filter("alone").select("b")
    tokens = wide.join(alone, "b", "left_anti").select("b", F.col("a").alias("id"), "root", "apart", "size", "length", F.size("own").alias("owned"), F.posexplode(F.concat("own", "common")).alias("at", "token"))
    tokens = materialize(tokens.withColumn("known", F.col("at") >= F.col("owned")).drop("at", "owned"), "tokens")
    counts = tokens.groupBy("b", "token").agg(F.count(F.lit(1)).alias("m"))
    ranked = tokens.join(counts, ["b", "token"]).withColumn("rank", F.row_number().over(Window.partitionBy("b", "id").orderBy("known", "m", "token")))
    posted = materialize(ranked.filter("rank <= length and m > 1").select("b", "token", "id", "root", "apart", "size", "rank"), "postings")
    discard(tokens)
    free_shuffles(members.sparkSession)
    lists = posted.groupBy("b", "token", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("b", "token").agg(F.max(F.struct("m", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("roots"))
    lists = posted.join(lists.filter("roots > 1").select("b", "token", "most"), ["b", "token"])
    other = lists.withColumnsRenamed({"id": "y", "root": "of_y", "apart": "y_apart", "size": "y_size", "rank": "y_rank"}).drop("most")
    need = F.ceil(F.round(F.lit(threshold / (1 + threshold)) * (F.col("size") + F.col("y_size")), 9))
    fits = (F.col("size") - F.col("rank") + 1 >= need) & (F.col("y_size") - F.col("y_rank") + 1 >= need) & (F.abs(F.col("apart") - F.col("y_apart")) <= far)
    met = lists.filter("root <> most").join(other, ["b", "token"]).filter((F.col("root") != F.col("of_y")) & fits)
    made = materialize(few.union(met.select(F.greatest("id", "y").alias("a"), F.least("id", "y").alias("b"))).distinct(), "rest")
    discard(rooted, posted)
    return made


def similarity_links(keyed: DataFrame, texts_of: Callable[[DataFrame], DataFrame], hashes: Callable[[Column], Column], threshold: float, rounds: int = 2, written: DataFrame | None = None) -> DataFrame:
    """(a, b): links of exact Jaccard threshold or more between units, enough to connect all that the colliding pairs connect.

    keyed: (id, n, band), the keys of each unit, which occurs n times. written: the table it is read from, deleted once it was. texts_of: from a column id to (id, text). hashes: the
    hashed shingles of a text. In each bucket all members are compared with one pivot, the most frequent unit, which near
    copies are made from; those that don't match it are compared with the most frequent among them, rounds times in all.
    What has been connected so far needn't meet again; for other pairs of a bucket see _rest. So a bucket of m near
    copies makes about m pairs, not m^2.
    """
    whole = left = links = first = None
    for _ in range(rounds):
        members = _pivots(keyed if left is None else left)
        if left is None:
            if written is not None:
                discard(written)
            free_shuffles(members.sparkSession)
        apart = members.filter("id <> pivot")
        pairs = apart.groupBy(F.col("id").alias("a"), F.col("pivot").alias("b")).agg(F.max("large").alias("large"))
        got = _compared(pairs if left is None else pairs.withColumn("large", F.lit(False)), texts_of, hashes, threshold)
        near = materialize(got.filter("near").select("a", "b"), "near")
        if left is None:
            whole, first, links = members, got, near
        else:
            links = links.union(near)
        left = apart.join(got.filter(~F.col("near")).select(F.col("a").alias("id"), F.col("b").alias("pivot")), ["id", "pivot"]).select("band", "id", "n")
    roots = materialize(components(links), "roots")
    rest = _rest(whole, first, roots, threshold)
    discard(*[x for x in (whole, first, members, got) if hasattr(x, "written_at")])
    last = _compared(rest.withColumn("large", F.lit(False)), texts_of, hashes, threshold)
    return links.union(last.filter("near").select("a", "b"))


def place_of(key: str, unit: str) -> Column:
    """A number that orders places by a long key, nulls last, and a number from 0 within it."""
    return F.expr(f"cast(coalesce(cast({key} as decimal(19,0)), 9999999999999999999BD) * 10000000000BD + {unit} as decimal(38,0))")


def first_place(place: str, key: str, unit: str) -> list[Column]:
    """The key and the number of a place."""
    of_unit = F.expr(f"pmod({place}, 10000000000BD)")
    of_key = F.when(F.col(place) < F.expr("9999999999999999999BD * 10000000000BD"), ((F.col(place) - of_unit) / F.expr("10000000000BD")).cast("long"))
    return [of_key.alias(key), of_unit.cast("int").alias(unit)]


def split_units(docs: DataFrame, key: str, text: str, normal: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """places (k, unit, h1, h2) and units (id, h1, h2, place, n, text), written: every line of docs that isn't empty after
    normal, and every different line with its least place and how often it occurs.

    unit counts the lines of a text from 0; h1 and h2 stand for the line's text.
    """
    split = docs.select(F.col(key).cast("long").alias("k"), F.posexplode(F.transform(F.split(F.col(text), "\n"), normal)).alias("unit", "text"))
    names = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), F.col("text")).alias("h2")]
    lines = materialize(split.filter("text <> ''").select("*", *names), "lines", "zstd")

    def grouped(some: DataFrame, part: int) -> DataFrame:
        made = some.withColumn("place", place_of("k", "unit")).groupBy("h1", "h2", "text").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))  # by its text, too, rows are hashed, not sorted
        return made.select((F.lit(part << 60) + F.monotonically_increasing_id()).alias("id"), "h1", "h2", "place", "n", "text")

    units = by_parts(lines, "h1", grouped, "units", "zstd")
    places = materialize(lines.drop("text"), "places")
    discard(lines)
    free_shuffles(docs.sparkSession)
    return places, units


def text_classes(places: DataFrame, units: DataFrame, key: str, keys: Callable[[DataFrame], DataFrame], hashes: Callable[[Column], Column], threshold: float) -> DataFrame:
    """unit_classes of what split_units wrote: each different text is signed once, where its keys are dealt out, and is kept
    under its id, so that neither keys nor places of texts are written or joined. keys: from units to (id, n, band), those under
    which texts meet.
    """

    def texts_of(ids: DataFrame) -> DataFrame:
        ids = materialize(ids, "wanted")
        return units.select("id", "text").join(_sent(ids), "id")

    links = similarity_links(keys(units), texts_of, hashes, threshold)
    return _placed(places, units.drop("text"), components(links), key, (), units)


def unit_classes(lines: DataFrame, signed: DataFrame, key: str, hashes: Callable[[Column], Column], threshold: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, unit, first_key, first_unit, members, *extra, keep) for every line.

    lines (k, unit, text) may hold h1, too; signed (k, unit, h1, h2, keys): unit counts the lines of a text from 0, h1 and h2
    stand for the line's text, keys are those under which it meets others. extra: more columns of signed. hashes: the hashed shingles of a text. first_*: the
    smallest (key, unit) of the line's class, which is kept; members: how many lines the class has. Equal lines are one unit
    from the start. Null keys come after all others. Keys are integers. Both tables are deleted in the end if they were
    written for this alone.
    """
    placed = signed.withColumn("place", place_of("k", "unit"))
    units = placed.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys"))
    keyed = materialize(units.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "place", "n", "keys"), "keyed")
    places = materialize(signed.drop("keys"), "places")
    if hasattr(signed, "written_at"):
        discard(signed)
    units = materialize(keyed.drop("keys"), "units")
    free_shuffles(lines.sparkSession)
    of_place = units.select("id", "h1", *first_place("place", "of", "at"))

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = materialize(of_place.join(ids, "id"), "wanted")
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        named = lines.select("k", "unit", "text", (F.col("h1") if "h1" in lines.columns else F.xxhash64("text")).alias("own"))
        found = named.join(wanted, named["k"].eqNullSafe(F.col("of")) & (named["unit"] == F.col("at")))
        return found.filter("own = h1").select("id", "text").dropDuplicates(["id"])  # keys may repeat

    roots = components(similarity_links(keyed.select("id", "n", F.explode("keys").alias("band")), texts_of, hashes, threshold, written=keyed))
    return _placed(places, units, roots, key, extra, units, *[x for x in [lines] if hasattr(x, "written_at")])


def _placed(places: DataFrame, units: DataFrame, roots: DataFrame, key: str, extra: tuple[str, ...], *read: DataFrame) -> DataFrame:
    """What unit_classes returns for places (k, unit, h1, h2, *extra), from units (id, h1, h2, place, n) and the roots of
    linked ones. read: written tables that are deleted once they are read.

    Units that are linked to none and occur once are their own class, of which no row need be made and joined.
    """
    roots = materialize(roots, "roots")
    rooted = units.join(_sent(roots).withColumnRenamed("node", "id"), "id", "left").filter("root is not null or n > 1")
    rooted = materialize(rooted.withColumn("root", F.coalesce("root", "id")), "rooted")
    discard(*read)
    firsts = rooted.groupBy("root").agg(F.min("place").alias("first"), F.sum("n").alias("members"))
    classes = rooted.join(firsts, "root").select("h1", "h2", "first", "members")
    found, alone = places.join(classes, ["h1", "h2"], "left"), F.col("first").isNull()
    of_key, of_unit = first_place("first", "first_key", "first_unit")
    own = [F.when(alone, F.col("k")).otherwise(of_key).alias("first_key"), F.when(alone, F.col("unit")).otherwise(of_unit).cast("int").alias("first_unit")]
    members, keep = F.coalesce("members", F.lit(1).cast("long")).alias("members"), (alone | (place_of("k", "unit") == F.col("first"))).alias("keep")
    return found.select(F.col("k").alias(key), "unit", *own, members, *extra, keep)
