"""Project features of parsed documents: text patterns, label/value tables, costs, OCR clean-up."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takeoff import constants as C
from takeoff.functions import names, rules
from takeoff.functions.numbers import round_half, strip
from takeoff.operators.quality import filled_share


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def building_type(text: Column) -> Column:
    return rules.first_words_of_long_text(text, C.DOCUMENT_TYPE_WORDS)


def structure(text: Column) -> Column:
    return rules.first_pattern(text, C.STRUCTURE_PATTERNS)


def decoration(text: Column) -> Column:
    return rules.first_pattern(text, C.DOCUMENT_DECORATION_PATTERNS)


def foundation(text: Column) -> Column:
    return rules.first_pattern(text, C.FOUNDATION_PATTERNS)


def location(text: Column) -> Column:
    return rules.first_contained(text, C.DOCUMENT_CITIES)


def area(text: Column, patterns: list[str] = C.AREA_PATTERNS) -> Column:
    return F.coalesce(*[found(text, p) for p in patterns]).try_cast("double")


def land_area(text: Column) -> Column:
    return area(text, C.LAND_AREA_PATTERNS)


def year(text: Column) -> Column:
    y = found(text, "(20\\d{2}|19\\d{2})").try_cast("int")
    return F.when(y.between(1950, 2030), y)


def floors(text: Column) -> Column:
    return names.max_number(text, "(\\d+)\\s*(?:层|楼)")


def floors_above(text: Column) -> Column:
    return found(text, "地上\\s*(\\d+)\\s*(?:层|楼)").try_cast("int")


def floors_below(text: Column) -> Column:
    return found(text, "地下\\s*(\\d+)\\s*(?:层|楼)").try_cast("int")


def project_name(filename: Column, text: Column) -> Column:
    """Value of the first name label, else the file name without its extension."""
    label = strip(found(text, "(?:项目名称|工程名称|项目).*?[：:]\\s*(.+?)(?:\\n|$)"))
    ext = F.length(names.extension(filename))
    return F.coalesce(label, F.nullif(F.substr(filename, F.lit(1), F.length(filename) - ext), F.lit("")))


def text_features(df: DataFrame, text: str = "full_text", filename: str = "filename") -> DataFrame:
    t = F.col(text)
    return df.withColumns({
        "project_name": project_name(F.col(filename), t), "building_type": building_type(t),
        "structure_type": structure(t), "total_area": area(t), "land_area": land_area(t), "location": location(t),
        "build_year": year(t), "floor_count": floors(t), "above_ground_floors": floors_above(t),
        "under_ground_floors": floors_below(t), "decoration_standard": decoration(t),
    })


# -- label / value tables ----------------------------------------------------

FIELDS = ["project_name", "building_type", "structure_type", "total_area", "land_area", "location", "build_year",
          "floor_count", "above_ground_floors", "under_ground_floors", "decoration_standard"]


def fuzzy_contains(text: Column, word: Column) -> Column:
    """Word contained, or all its characters but the last found in order; look-alikes count as equal."""
    alike = [a + b for a, b in C.OCR_PAIRS] + [b + a for a, b in C.OCR_PAIRS]

    def step(i: Column, ch: Column) -> Column:
        want = F.substr(word, i + 1, F.lit(1))
        return F.when((i < F.length(word)) & ((ch == want) | F.concat(ch, want).isin(alike)), i + 1).otherwise(i)

    in_order = F.aggregate(F.split(text, ""), F.lit(0), step) >= F.length(word) - 1
    return text.contains(word) | in_order


class LabelScan:
    """All labels matched at once, with one missing last character allowed: a bit for each label and number of characters found.

    A text is gone through once; each character moves the bits that wait for it, look-alikes counting as equal. The bits of all
    labels lie in a few whole numbers, so the cost doesn't grow with the labels until a number is full.
    """

    BITS = 62

    def __init__(self, labels: list[tuple[str, str]]):
        alike: dict[str, set[str]] = {}
        for a, b in C.OCR_PAIRS:
            alike.setdefault(a, set()).add(b)
            alike.setdefault(b, set()).add(a)
        self.start, self.masks, self.entries, used = [0], {}, [], 0
        for label, field in labels:
            if used + len(label) + 1 > self.BITS:
                self.start.append(0)
                used = 0
            word = len(self.start) - 1
            self.start[word] |= 1 << used
            for i, ch in enumerate(label):
                for c in {ch} | alike.get(ch, set()):
                    self.masks.setdefault(c, {}).setdefault(word, 0)
                    self.masks[c][word] |= 1 << (used + i)
            self.entries.append((label, field, word, 3 << (used + len(label) - 1)))
            used += len(label) + 1

    def labels(self) -> Column:
        """label, field, and where the bits stand that tell of a match."""
        return F.array(*[F.struct(F.lit(x).alias("label"), F.lit(f).alias("field"), F.lit(w).alias("word"), F.lit(bits).cast("bigint").alias("bits")) for x, f, w, bits in self.entries])

    def states(self, text: Column) -> Column:
        n = len(self.start)
        whole = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
        moves = F.create_map(*[x for c, m in self.masks.items() for x in (F.lit(c), whole(m.get(w, 0) for w in range(n)))])
        move = lambda s, m: (s.bitwiseAND(F.bitwise_not(m))).bitwiseOR(F.shiftleft(s.bitwiseAND(m), 1))
        step = lambda state, ch: F.coalesce(F.zip_with(state, F.try_element_at(moves, ch), move), state)
        return F.aggregate(F.split(text, ""), whole(self.start), step)

    @staticmethod
    def told(states: Column, label: Column) -> Column:
        return F.get(states, label["word"]).bitwiseAND(label["bits"]) != 0


def value_after(row: Column, states: Column, label: Column) -> Column:
    """Value next to a label: behind a colon in its cell, else the next cell, else the last word of its cell; `states` of each cell."""
    def at(i: Column) -> Column:
        c = strip(F.coalesce(F.get(row, i), F.lit("")))
        behind = strip(F.nullif(F.call_function(
            "regexp_extract", c, F.concat(label["label"], F.lit("\\s*[:：]\\s*(.+)")), F.lit(1)), F.lit("")))
        following = F.nullif(strip(F.coalesce(F.get(row, i + 1), F.lit(""))), F.lit(""))
        words = F.split(c, "\\s+")
        last = F.when(F.size(words) >= 2, F.get(words, F.size(words) - 1))
        return F.when(LabelScan.told(F.get(states, i), label), F.coalesce(
            behind, F.when(~following.eqNullSafe(label["label"]), following), last))

    values = F.transform(F.sequence(F.lit(0), F.size(row) - 1), at)
    return F.get(F.filter(values, lambda v: v.isNotNull()), 0)


def parse_value(field: Column, value: Column, label_length: int = 10, place_length: int = 20) -> Column:
    """Text of a value read as its field wants it, null when it does not fit.

    An unknown structure, decoration or place counts as such up to the given lengths; longer cells are sentences.
    """
    value = strip(value)
    short = lambda n: F.when(F.length(value) <= n, value)
    return (
        F.when(field.isin("total_area", "land_area"), found(value, "(\\d+(?:\\.\\d+)?)"))
        .when(field.isin("floor_count", "above_ground_floors", "under_ground_floors", "build_year"), found(value, "(\\d+)"))
        .when(field == "structure_type", F.coalesce(structure(value), short(label_length)))
        .when(field == "building_type", building_type(value))
        .when(field == "decoration_standard", F.coalesce(decoration(value), short(label_length)))
        .when(field == "location", F.coalesce(location(value), short(place_length)))
        .otherwise(F.nullif(value, F.lit(""))))


def table_rows(tables: Column) -> Column:
    return F.flatten(tables)


def table_features(df: DataFrame, tables: str = "tables") -> DataFrame:
    """Fill fields the text left empty from label/value rows; a row fills at most one field.

    Candidates are listed per row in label order; folding over the rows, the
    first candidate of a row whose field is still empty is taken.
    """
    scan = LabelScan(C.TABLE_LABELS)
    rows = F.filter(table_rows(F.col(tables)), lambda r: F.size(r) >= 2)

    def scanned(row: Column) -> Column:
        """The row's cells with the scan's states of each and of the whole line."""
        cells = F.transform(row, lambda c: strip(F.coalesce(c, F.lit(""))))
        line = F.array_join(F.filter(cells, lambda c: c != ""), " ")
        return F.struct(row.alias("cells"), F.transform(cells, scan.states).alias("states"), scan.states(line).alias("whole"))

    def candidates(row: Column) -> Column:
        near = F.filter(scan.labels(), lambda x: scan.told(row["whole"], x))
        read = F.transform(near, lambda x: F.struct(
            x["field"].alias("field"), parse_value(x["field"], value_after(row["cells"], row["states"], x)).alias("value")))
        return F.filter(read, lambda x: x["value"].isNotNull())

    given = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in FIELDS]))
    empty = F.array().cast("array<struct<field:string,value:string>>")

    def fold(acc: Column, row: Column) -> Column:
        free = F.filter(row, lambda x: ~F.exists(acc, lambda a: a["field"] == x["field"])
                        & ~F.array_contains(F.col("_given"), x["field"]))
        return F.concat(acc, F.slice(free, 1, 1))

    taken = F.aggregate(F.transform(F.transform(rows, scanned), candidates), empty, fold)
    out = df.withColumn("_given", given).withColumn("_taken", F.coalesce(taken, empty)).withColumn(
        "_map", F.map_from_arrays(F.transform("_taken", lambda x: x["field"]), F.transform("_taken", lambda x: x["value"])))
    kinds = dict(df.dtypes)
    return out.withColumns({
        **{f: F.coalesce(F.col(f), F.try_element_at("_map", F.lit(f)).try_cast(kinds[f])) for f in FIELDS},
        "table_fields": F.map_keys("_map"),
    }).drop("_given", "_taken", "_map")


# -- costs -------------------------------------------------------------------

def cost_value(cell: Column) -> Column:
    """Amount in yuan: thousands commas, 万元 and 亿元 units; a plain number counts above 1000."""
    text = strip(F.regexp_replace(cell, "[,，]", ""))
    n = found(text, "(\\d+(?:\\.\\d+)?)").try_cast("double")
    return F.when(text.contains("亿元"), n * 1e8).when(text.contains("万元"), n * 1e4).when(n > 1000, n)


def table_cost(df: DataFrame, tables: str = "tables") -> DataFrame:
    """Total cost of the first total row with a cell above 10000, and the price per square metre."""
    total_rows = F.filter(table_rows(F.col(tables)), lambda r: F.array_join(r, " ").rlike(C.TOTAL_ROW_PATTERN))
    values = F.transform(total_rows, lambda r: F.get(F.filter(F.transform(r, cost_value), lambda v: v > 10000), 0))
    return df.withColumn("total_cost", F.get(F.filter(values, lambda v: v.isNotNull()), 0)).withColumn(
        "unit_price", F.when(F.col("total_area") > 0, round_half(
            F.col("total_cost") / F.nullif(F.col("total_area"), F.lit(0.0)), 2)))


def with_confidence(df: DataFrame) -> DataFrame:
    """Confidence and source of every field as maps.

    Fields of the text list always get a confidence, 0 when missing; a name read
    from a table keeps the table confidence.
    """
    from_text = ["building_type", "structure_type", "total_area", "location", "build_year", "floor_count",
                 "decoration_standard"]
    optional = ["land_area", "above_ground_floors", "under_ground_floors"]
    name_in_table = F.array_contains("table_fields", "project_name") if "table_fields" in df.columns else F.lit(False)
    level = {
        **{f: F.when(F.col(f).isNotNull(), 0.8).otherwise(0.0) for f in from_text},
        "total_cost": F.when(F.col("total_cost").isNotNull(), 0.7).otherwise(0.0),
        "unit_price": F.when(F.col("unit_price").isNotNull(), 0.6).otherwise(0.0),
        **{f: F.when(F.col(f).isNotNull(), 0.8) for f in optional},
        "project_name": F.when(name_in_table, 0.85),
    }
    source = {f: F.when(F.col(f).isNotNull(), "text") for f in [*from_text, *optional]}
    source["total_cost"] = F.when(F.col("total_cost").isNotNull(), "table")
    source["unit_price"] = F.when(F.col("unit_price").isNotNull(), "inferred")
    source["project_name"] = F.when(name_in_table, "table")

    def as_map(cols: dict[str, Column]) -> Column:
        both = F.map_from_arrays(F.array(*[F.lit(k) for k in cols]), F.array(*cols.values()))
        return F.map_filter(both, lambda k, v: v.isNotNull())

    return df.withColumns({"confidence": as_map(level), "extraction_source": as_map(source)})


def completeness(df: DataFrame) -> Column:
    return filled_share([F.col(c) for c in ("building_type", "total_area", "structure_type", "location")])


def document_features(docs: DataFrame) -> DataFrame:
    """All features of parsed documents with confidences."""
    return with_confidence(table_cost(table_features(text_features(docs))))


# -- OCR and pages -----------------------------------------------------------

def clean_ocr(text: Column) -> Column:
    """Join broken lines and repair usual misreadings.

    A line joins the one before when that one is not blank and does not end in a
    mark, and the line itself opens no list entry.  m2 and its misreadings become
    a square-metre sign only behind a digit or blank.
    """
    t = F.regexp_replace(text, "[^\\S\\n]+(?=\\n|\\z)", "")
    t = F.regexp_replace(t, "\\A\\n+", "")
    t = F.regexp_replace(t, "\\n+\\z", "\n")
    t = F.regexp_replace(t, "\\n{3,}", "\n\n")
    t = F.regexp_replace(t, f"(?<=[^\\n{C.LINE_END_MARKS}])\\n(?=[^\\n])(?![\\d一二三四五六七八九十]+[、.．])(?!【)", "")
    t = F.regexp_replace(t, "(?<=\\d)l(?=\\d)", "1")
    t = F.regexp_replace(t, "(?<=\\d)O(?=\\d)", "0")
    t = F.regexp_replace(t, "。。+", "。")
    t = F.regexp_replace(t, "，，+", "，")
    t = F.regexp_replace(t, "  +", " ")
    t = F.regexp_replace(t, ",\\n(\\d)", ",$1")
    return F.regexp_replace(t, "(?<=[\\d ])(?:rn2|[rnm]2)(?![0-9])", "㎡")


def page_scan(pages: DataFrame, doc: str, text: Column, confidence: Column) -> DataFrame:
    """Scanned pages of a document, whether it counts as scanned, and its mean page confidence."""
    size = F.length(strip(F.coalesce(text, F.lit(""))))
    band = F.when(size < 50, "scanned").when(size < 200, "partial").otherwise("text")
    seen = F.when(confidence > 0, confidence)
    tagged = pages.select(doc, band.alias("band"), seen.cast("decimal(18,4)").alias("conf"))
    n = F.count(F.lit(1))
    mean = F.sum("conf").cast("double") / F.nullif(F.count("conf"), F.lit(0))
    return tagged.groupBy(doc).agg(
        n.alias("pages"), F.count(F.when(F.col("band") == "scanned", 1)).alias("scanned_pages"),
        F.count(F.when(F.col("band") == "partial", 1)).alias("partial_pages"),
        (F.count(F.when(F.col("band") == "scanned", 1)) / n > 0.5).alias("is_scanned"),
        round_half(mean, 2).alias("avg_confidence"), F.coalesce(mean < 60, F.lit(False)).alias("low_confidence"))


def context_summary(docs: DataFrame, preview_length: int | None = None) -> Column:
    """Description of a document and its features for a reader; its text is whole unless a length is given."""
    def line(label: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(label + ": "), value.cast("string")))

    def whole(c: Column) -> Column:
        return F.nullif(F.round(c.cast("decimal(24,4)"), 0).cast("bigint"), F.lit(0))

    floors_line = F.when(
        F.col("above_ground_floors").isNotNull() | F.col("under_ground_floors").isNotNull(),
        F.concat(F.lit("   (地上 "), F.coalesce(F.col("above_ground_floors").cast("string"), F.lit("?")), F.lit(" 层, 地下 "),
                 F.coalesce(F.col("under_ground_floors").cast("string"), F.lit("?")), F.lit(" 层)")))
    shown = F.col("full_text") if preview_length is None else F.substring("full_text", 1, preview_length)
    preview = F.when(F.coalesce("full_text", F.lit("")) != "", F.concat(
        F.lit("文档摘要: "), F.regexp_replace(shown, "\\n", " "), F.lit("" if preview_length is None else "...")))
    return F.concat_ws(
        "\n", line("文件", F.col("filename")),
        F.concat(F.lit("格式: "), F.col("file_format"), F.lit(" | 页数: "), F.col("pages").cast("string"), F.lit(" | 扫描件: "),
                 F.when(F.col("is_scanned"), "是").otherwise("否")),
        line("项目名称", F.col("project_name")), line("建筑类型", F.col("building_type")),
        line("结构类型", F.col("structure_type")), line("总建筑面积", whole(F.col("total_area"))),
        line("楼层数", F.col("floor_count")), floors_line, line("所在地区", F.col("location")),
        line("建造年份", F.col("build_year")), line("装修标准", F.col("decoration_standard")),
        line("项目总造价", F.col("total_cost").cast("decimal(24,2)")), line("单方造价", F.col("unit_price").cast("decimal(24,2)")),
        F.concat(F.lit("特征完整度: "), (completeness(docs) * 100).cast("int").cast("string"), F.lit("%")), preview,
        F.when(F.size("warnings") > 0, F.concat(F.lit("解析警告: "), F.array_join("warnings", "; "))))
