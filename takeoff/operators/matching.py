"""Name matching and similar-project search without pairwise comparison."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeoff import constants as C
from takeoff.functions import rules
from takeoff.functions.names import CJK
from takeoff.operators import ordered
from takeoff.session import checkpoint_folder

# -- names -------------------------------------------------------------------


def tokens(name: Column, least: int = 3) -> Column:
    """Distinct runs of at least so many CJK characters."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(name, F.lit(f"([{CJK}]{{{least},}})"), F.lit(1))))


def token_pairs(words: Column) -> Column:
    """All two-word combinations of one name, as text keys."""
    return F.flatten(F.transform(words, lambda a: F.transform(
        F.filter(words, lambda b: b > a), lambda b: F.concat_ws("|", a, b))))


def grams(text: Column, size: Column | int) -> Column:
    """Distinct substrings of one size; none of a shorter text."""
    size = F.lit(size) if isinstance(size, int) else size
    some = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, size))
    return F.when(F.length(text) >= size, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def first_containing(names: DataFrame, texts: DataFrame, value: Column, q: int = 3) -> DataFrame:
    """(name, first): the least `value` among the texts that contain each name; names without any don't show.

    A name is looked for under one of its q-grams only, the one that fewest texts have (shorter names under themselves), and
    then compared. The rows that are shuffled grow with the length of a text, not with its square.
    """
    offered = texts.select("text", value.alias("value"), F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.col("text"), k) for k in range(1, q + 1)])))).alias("gram"))
    frequency = offered.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = names.select("name").distinct().where(F.length("name") > 0)
    asked = asked.select("name", F.explode(grams(F.col("name"), F.least(F.length("name"), F.lit(q)))).alias("gram"))
    # a name with a gram that no text has is in none
    known = asked.join(frequency, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    keyed = known.where("rarest.n > 0").select("name", F.col("rarest.gram").alias("gram"))
    return keyed.join(offered, "gram").where(F.contains("text", "name")).groupBy("name").agg(F.min("value").alias("first"))


#: Dictionaries of so many words are broadcast, larger ones meet the texts by a shuffle.
BROADCAST_WORDS = 200_000
#: Characters of a text in which words of a dictionary are looked for at a time.
STRETCH = 256


def dictionary_hits(texts: DataFrame, key: str, text: str, dictionary: DataFrame, q: int = 4) -> DataFrame:
    """(key, word, place, seq) of every word of a dictionary at every place of a text; dictionary: word, seq.

    The dictionary is a table, so a plan doesn't grow with it. A text offers its runs of `q` characters, and of fewer where the
    dictionary has shorter words; words wait under the run that they begin with, and what follows is compared.
    """
    known = dictionary.where(F.length("word") > 0)
    sizes, longest = known.agg(F.array_sort(F.collect_set(F.least(F.length("word"), F.lit(q)))), F.coalesce(F.max(F.length("word")), F.lit(1))).first()  # q sizes at most
    words = known.select("word", "seq", F.substring("word", 1, q).alias("head"))
    words = F.broadcast(words) if words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else words
    # stretches of a text, each with what a word that begins in it needs: places in a short text are found at once
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{1,{STRETCH + longest}}})).{{1,{STRETCH}}}"), F.lit(1))
    parts = texts.select(key, F.posexplode(pieces).alias("_n", "_part")).select(key, (F.col("_n") * STRETCH + 1).alias("_start"), "_part")
    part = F.col("_part")
    # a regular expression reads a text or part once, whereas a substring is counted off from its beginning
    runs = lambda size: F.slice(F.regexp_extract_all(part, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1)), 1, STRETCH)
    offered = F.concat(*[F.transform(runs(size), lambda h, i: F.struct((i + 1).alias("at"), h.alias("head"))) for size in sizes or [q]])
    each = parts.select(key, "_start", "_part", F.explode(offered).alias("r")).select(key, "_start", "_part", "r.at", "r.head")
    hits = each.join(words, "head").where(F.substr("_part", F.col("at"), F.length("word")) == F.col("word"))
    return hits.select(key, "word", (F.col("_start") + F.col("at") - 1).alias("place"), "seq")


def dictionary_match(texts: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """Per text that holds a word: key, first (the word with the lowest seq) and longest (of equal length the lowest seq)."""
    hits = dictionary_hits(texts, key, text, dictionary).select(key, "word", "seq").distinct()  # hashed; what follows sorts
    return hits.groupBy(key).agg(F.min_by("word", F.struct("seq", "word")).alias("first"), F.min_by("word", F.struct(-F.length("word"), "seq", "word")).alias("longest"))


def _first_folder(folders: DataFrame, keys: Column) -> DataFrame:
    """Key -> first folder (by name) that has the key; one row a key, combined before the shuffle."""
    return folders.select("folder", F.explode(keys).alias("k")).groupBy("k").agg(F.min("folder").alias("folder"))


def main_workbooks(files: DataFrame) -> DataFrame:
    """(folder, file): the first main workbook, by name, of each folder that holds one."""
    main = F.col("file").endswith(C.MAIN_WORKBOOK_SUFFIX) & ~F.contains("file", F.lit(C.INFO_WORKBOOK_MARK))
    return files.where(main).groupBy("folder").agg(F.min("file").alias("file"))


def match_folders(projects: DataFrame, files: DataFrame) -> DataFrame:
    """First folder, in name order, that fits each project name and holds a main workbook; null where none does.

    files: folder, file. A folder fits when it shares min(2, n) of the name's n word runs, or when n
    is at most 3 and it contains a run of four or more characters. One that fits without a main workbook gives way to the next, so
    only folders with one are looked at; they are reduced to the first one a key (single run, pair of runs, contained run)
    before they meet the projects, so a word that everybody uses costs one row.
    """
    words = tokens(F.col("name"))
    p = projects.select("project_id", "name", words.alias("w"))
    held = main_workbooks(files)
    f = held.select("folder").withColumn("fw", tokens(F.col("folder"))).filter(F.size("fw") > 0)
    long_runs = F.filter("w", lambda x: F.length(x) >= 4)
    key = lambda kind, ks: F.transform(ks, lambda k: F.concat_ws(":", F.lit(kind), k))
    wanted = F.concat(
        F.when(F.size("w") == 1, key("one", F.col("w"))).otherwise(key("two", token_pairs(F.col("w")))),
        F.when(F.size("w") <= 3, key("in", long_runs)).otherwise(F.array().cast("array<string>")))
    asked = p.select("project_id", F.explode(wanted).alias("k"))
    first = _first_folder(f, F.concat(key("one", F.col("fw")), key("two", token_pairs(F.col("fw")))))
    runs = asked.where(F.col("k").startswith("in:")).select(F.substring("k", 4, 1 << 30).alias("name"))
    inside = first_containing(runs, f.select(F.explode("fw").alias("text"), "folder"), F.col("folder"), 4)
    first = first.union(inside.select(F.concat(F.lit("in:"), "name"), "first"))
    found = asked.join(first.hint("merge"), "k").groupBy("project_id").agg(F.min("folder").alias("folder"))
    return p.select("project_id", "name").join(found, "project_id", "left").join(held, "folder", "left").select("project_id", "name", "folder", "file")


def match_files(projects: DataFrame, files: DataFrame) -> DataFrame:
    """File of each project: same file name, else the first file of the first folder whose name contains the project name.

    projects: project_id, name, source_file.  files: folder, file.
    """
    by_file = files.groupBy(F.col("file").alias("source_file")).agg(F.min(F.struct("folder", "file")).alias("_exact"))
    first_file = files.groupBy("folder").agg(F.min("file").alias("file"))
    by_name = first_containing(projects, first_file.select(F.col("folder").alias("text"), F.struct("folder", "file").alias("f")), F.col("f")).withColumnRenamed("first", "_inside")
    return (
        projects.join(by_file, "source_file", "left").join(by_name, "name", "left")
        .withColumn("_f", F.coalesce("_exact", "_inside"))
        .select("project_id", F.col("_f.folder").alias("folder"), F.col("_f.file").alias("file"),
                F.when(F.col("_exact").isNotNull(), "file_name").when(F.col("_inside").isNotNull(), "folder_name")
                .otherwise("none").alias("matched_by"))
    )


# -- similar projects --------------------------------------------------------
#
# A project scores 2 for the same structure and 3 / 2 / 1 when its area differs
# by less than 30 / 50 / 100 percent.  The k best of a type, ties by sequence,
# are always among the k lowest sequence numbers of one of these sets: area
# within one of these differences (or any area), of the same structure (or any
# structure), as whatever else is in such a set scores no less.  Areas are
# replaced by their places among the different areas of the projects, so requests
# that have the same projects within each difference are one, and the work grows with
# the requests that differ, not with all.  Places are kept in a tree: every node
# keeps its k lowest sequence numbers, and a range is covered by a few nodes.
# One more node on top holds any area at all.

SHIFTS = range(0, 33, 2)  # bits that a node of each level leaves out
ALL_LEVEL = len(SHIFTS)
#: Areas beyond this, either way, count as this: their hundredths still fit into 64 bits when they are doubled.
MAX_AREA = 4e16
BANDS = [(3, 10, 3), (5, 10, 2), (10, 10, 1)]  # numerator, denominator, score
ANY = "*"


def cents(area: Column) -> Column:
    within = F.when(area.isNotNull() & ~F.isnan(area), F.greatest(F.least(area, F.lit(MAX_AREA)), F.lit(-MAX_AREA)))
    return F.coalesce(F.round(within.cast("decimal(24,4)") * 100, 0).cast("bigint"), F.lit(0))


def _reach(span: Column, num: int, den: int) -> Column:
    """Largest whole number below span * num / den, without leaving 64 bits (num <= den)."""
    quotient, rest = F.call_function("div", span, F.lit(den)), span % den
    return quotient * num + F.call_function("div", rest * num + (den - 1), F.lit(den)) - 1


def _area_nodes(place: Column) -> Column:
    """The node of the area's place on every level, leaf first, and the node of all areas."""
    return F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright(place, bits).alias("node")) for level, bits in enumerate(SHIFTS)],
                   F.struct(F.lit(ALL_LEVEL).alias("level"), F.lit(0).cast("bigint").alias("node")))


def _cover(ranges: DataFrame) -> DataFrame:
    """Nodes that together cover the whole numbers low..high of each row (columns level, node).

    On each level the nodes that are inside the range, but whose parent is not,
    are taken: at most 3 at either end, any number on top.
    """
    down = lambda c, bits: F.call_function("shiftright", c, bits)  # noqa: E731  floor of the division by a power of two
    up = lambda c, bits: F.call_function("shiftleft", c, bits)
    levels = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(bits).alias("bits"), F.lit(above - bits).alias("more"))
                       for level, (bits, above) in enumerate(zip(SHIFTS, [*SHIFTS[1:], SHIFTS[-1]]))])
    one = ranges.select("*", F.inline(levels)).withColumns({
        "first": -down(-F.col("low"), F.col("bits")), "last": down(F.col("high") + 1, F.col("bits")) - 1,
    }).filter("first <= last")
    more = F.col("more")
    parents = one.withColumns({
        "p_first": up(-down(-F.col("first"), more), more), "p_last": up(down(F.col("last") + 1, more), more) - 1})
    inner = (F.col("p_first") <= F.col("p_last")) & (more > 0)
    none = F.array().cast("array<bigint>")

    def run(start: Column, end: Column) -> Column:
        return F.when(start <= end, F.sequence(start, F.greatest(start, end))).otherwise(none)

    nodes = F.concat(run(F.col("first"), F.when(inner, F.col("p_first") - 1).otherwise(F.col("last"))),
                     F.when(inner, run(F.col("p_last") + 1, F.col("last"))).otherwise(none))
    return parents.withColumn("node", F.explode(nodes)).drop("low", "high", "bits", "more", "first", "last", "p_first", "p_last")


def _places(areas: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(area100, place) of all areas above 0, numbered from 1, and (req100, spans): the first and last place within each band."""
    a = F.col("req100")
    wanted = asked.filter(a > 0).distinct()
    reaches = [_reach(F.greatest(a, F.lit(100)), num, den) for num, den, _ in BANDS]  # |x - a| * den < span * num, in whole hundredths
    edges = [e for r in reaches for e in (F.greatest(a - r, F.lit(1)) - 1, a + r)]
    ends = wanted.select("req100", F.posexplode(F.array(*edges)).alias("i", "area100"))
    own = areas.filter("area100 > 0").distinct()
    upto = ordered.counts_upto(own, ends, "area100", "place")
    counts = ends.join(upto, "area100").groupBy("req100").agg(*[F.max(F.when(F.col("i") == i, F.col("place"))).alias(f"e{i}") for i in range(len(edges))])
    spans = F.array(*[F.struct((F.col(f"e{i}") + 1).alias("low"), F.col(f"e{i + 1}").alias("high")) for i in range(0, len(edges), 2)])
    return own.join(upto, "area100"), counts.select("req100", spans.alias("spans"))


def _keep_lowest(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("seq")
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def with_type_fit(projects: DataFrame) -> DataFrame:
    """Flag projects that stand for their type.

    Where a type has more than 3 projects and at least 3 of them have a name that
    fits the type, only those do; else all do.
    """
    fits = rules.chain([(F.col("building_type") == t, rules.contains_any(F.col("name"), words))
                        for t, words in C.SIMILAR_NAME_WORDS])
    sizes = projects.groupBy("building_type").agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(fits, 1)).alias("_fit"))
    strict = F.coalesce((F.col("_n") > 3) & (F.col("_fit") >= 3), F.lit(False))
    # one row a building type; Spark decides by its size whether to broadcast it
    return projects.join(sizes, "building_type", "left").withColumn(
        "fits_type", ~strict | F.coalesce(fits, F.lit(False))).drop("_n", "_fit")


def similar_projects(requests: DataFrame, projects: DataFrame, k: int = 5) -> DataFrame:
    """The k most similar projects of every request.

    requests: request_id, building_type, structure_type, total_area.
    projects: project_id, seq (unique, order of entry), name, building_type, structure_type, total_area.
    Projects of the same type only; a type without projects falls back to other types with a positive score,
    where the same structure counts 1.  Equal scores keep the order of entry.
    """
    known = projects.filter(F.coalesce(F.col("building_type"), F.lit("")) != "").withColumn(
        "area100", cents(F.col("total_area")))
    types = known.select("building_type").distinct()
    strange = requests.join(types, "building_type", "left_anti").limit(1).select(F.lit(True)).scalar()
    # a project is offered under its own type and, only when some request asks for an unknown type, under any type
    offered = F.array_compact(F.array(
        F.when(F.col("fits_type"), F.col("building_type")), F.when(F.coalesce(strange, F.lit(False)), F.lit(ANY))))
    listed = with_type_fit(known).select(
        "project_id", "seq", F.coalesce("structure_type", F.lit("")).alias("s"), "area100", F.explode(offered).alias("t"))
    # equal type, structure and area: only the k first can ever be returned
    checkpoint_folder(requests.sparkSession)
    pool = _keep_lowest(listed, ["t", "s", "area100"], k).repartition(
        int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq").checkpoint()  # read by the places, twice, and the tree
    asked = requests.join(types.withColumn("_known", F.lit(True)), "building_type", "left").select(
        "request_id", F.when(F.col("_known"), F.col("building_type")).otherwise(F.lit(ANY)).alias("t"),
        F.coalesce("structure_type", F.lit("")).alias("s_req"), cents(F.col("total_area")).alias("req100"))
    places, spans = _places(pool.select("area100"), asked.select("req100"))
    placed = pool.join(places, "area100", "left").withColumn("place", F.coalesce("place", F.lit(0)))
    node = placed.select("project_id", "seq", "t", "s", "place", F.inline(_area_nodes(F.col("place"))))
    both = node.select("*", F.explode(F.array(F.col("s"), F.lit(ANY))).alias("s_key"))
    index = _keep_lowest(both, ["t", "s_key", "level", "node"], k)

    none = F.array(*[F.struct(F.lit(1).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("high"))] * len(BANDS))
    asked = asked.join(spans, "req100", "left").withColumn("spans", F.coalesce("spans", none))
    shapes = asked.select("t", "s_req", "spans").distinct()
    # a shape fans out into dozens of rows, so the shapes are dealt out to all tasks first
    spread = shapes.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), "spans")
    ranges = spread.select("t", "s_req", "spans", F.inline(F.array_distinct("spans"))).filter("low <= high")
    everything = shapes.select("t", "s_req", "spans", F.lit(ALL_LEVEL).alias("level"), F.lit(0).cast("bigint").alias("node"))
    probes = _cover(ranges).unionByName(everything).withColumn("s_key", F.explode(F.array(F.col("s_req"), F.lit(ANY))))
    # both sides grow by fan-out, which size estimates before the fan-out do not see: never broadcast them
    hits = probes.join(index.hint("merge"), ["t", "s_key", "level", "node"]).select(
        "t", "s_req", "spans", "project_id", "seq", "s", "place").distinct()
    within = [F.col("place").between(F.col("spans")[i]["low"], F.col("spans")[i]["high"]) for i in range(len(BANDS))]
    area_score = rules.chain([(inside, F.lit(score)) for inside, (_, _, score) in zip(within, BANDS)], 0)
    same = F.when(F.col("s") == F.col("s_req"), F.when(F.col("t") == ANY, 1).otherwise(2)).otherwise(0)
    scored = hits.withColumn("score", area_score + same).filter((F.col("t") != ANY) | (F.col("score") > 0))
    best = Window.partitionBy("t", "s_req", "spans").orderBy(F.desc("score"), "seq")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return asked.join(ranked, ["t", "s_req", "spans"]).select(
        "request_id", "rank", "project_id", "score", (F.col("t") != ANY).alias("same_type"))
