"""Translation of headers by dictionaries, all sites at once.

A dictionary file is read as cells (file, row, col, text). Headers to translate
come as (file, pos, raw); ``file`` names the dictionary (site) to look in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions.text import (
    CODE,
    hint_score,
    looks_like_unit,
    normalize,
    normalize_text,
    similarity,
    split_unit,
)
from fleetspark.operators.fuzzy import candidates
from fleetspark.operators.ordered import sized
from fleetspark.params import DictionaryParams
from fleetspark.session import stored

# Header words of the five families, strong key words, empty units.
KEY_HINTS = ("csv", "code", "コード", "key", "id", "tag", "タグ", "signal", "point", "列名", "column", "raw", "item")
NAME_HINTS = ("項目名称", "名称", "名前", "説明", "日本語", "name", "title", "label", "意味", "内容", "表示")
UNIT_HINTS = ("単位", "unit", "単位系")
NOTE_HINTS = ("備考", "注記", "note", "remark", "コメント", "comment", "詳細")
KIND_HINTS = ("計測値種別", "種別", "区分", "type", "kind", "measurement", "集計")
STRONG_KEY = ("csv", "code", "コード", "tag", "タグ", "key", "id", "raw", "列名")
NO_UNIT = ("-", "--", "なし")
FAMILIES = {"key": KEY_HINTS, "name": NAME_HINTS, "unit": UNIT_HINTS, "kind": KIND_HINTS, "note": NOTE_HINTS}
MIN_SUBSTRING = 4


def header_rows(cells: DataFrame, max_scan: int = 12) -> DataFrame:
    """Per dictionary the row that looks most like a header: file, header_row."""
    words = KEY_HINTS + NAME_HINTS + UNIT_HINTS
    scored = cells.where((F.col("row") < max_scan) & F.col("text").isNotNull()).withColumn("_h", normalize("text"))
    rows = scored.groupBy("file", "row").agg(
        F.count(F.lit(1)).alias("_filled"), F.sum(hint_score("_h", words)).alias("_hits"))
    rows = rows.where(F.col("_filled") >= 2).withColumn("_score", F.col("_filled") + 3 * F.col("_hits"))
    return rows.groupBy("file").agg(
        F.min_by("row", F.struct(-F.col("_score"), F.col("row"))).alias("header_row"))


def family(header: Column) -> Column:
    """key, name, unit, kind or note, by a normalised header; null if nothing points anywhere."""
    strong = F.lit(False)
    for w in STRONG_KEY:
        strong = strong | header.contains(normalize_text(w))
    score = {f: hint_score(header, hints) for f, hints in FAMILIES.items()}
    best = F.greatest(*score.values())
    out = F.when(strong, "key").when(best <= 0, None)
    for f in ("name", "unit", "kind", "note", "key"):
        out = out.when(score[f] == best, f)
    return out


def code_ratio(text: str = "text") -> Column:
    """Aggregate: share of the filled values that look like machine identifiers."""
    t = F.trim(text)
    return F.coalesce(F.avg(F.when(t != "", t.rlike(CODE).cast("double"))), F.lit(0.0))


def blocks(cells: DataFrame, params: DictionaryParams = DictionaryParams()) -> DataFrame:
    """Dictionaries side by side: file, block, and the columns of each family.

    A block starts at every key column and ends before the next.
    """
    heads = cells.join(sized(header_rows(cells)), "file")
    header = heads.where(F.col("row") == F.col("header_row")).select(
        "file", "header_row", "col", F.trim("text").alias("head"))
    body = heads.where(F.col("row") > F.col("header_row")).select("file", "row", "col", "text")
    cols = body.groupBy("file", "col").agg(
        code_ratio().alias("code"),
        F.coalesce(F.avg(looks_like_unit("text").cast("double")), F.lit(0.0)).alias("unitish"))
    width = cells.groupBy("file").agg((F.max("col") + 1).alias("n_cols"))
    heads = (
        cols.join(header, ["file", "col"], "full").drop("header_row")
        .join(header.select("file", "header_row").distinct(), "file").join(width, "file")
        .withColumn("head", F.coalesce("head", F.lit(""))).withColumn("_h", normalize("head"))
        .withColumn("fam", F.when(F.col("head") != "", family(F.col("_h"))))
        .fillna(0.0, ["code", "unitish"])
    )
    heads = sized(heads)
    plain = (F.col("fam") == "key") & (F.col("code") >= 0.5)
    coded = F.coalesce(F.col("fam") == "name", F.lit(True)) & (F.col("code") >= 0.6) & (
        hint_score("_h", KEY_HINTS) > 0) & (F.col("head") != "")
    is_key = F.coalesce(plain, F.lit(False)) | F.coalesce(coded, F.lit(False))
    if params.raw_col and params.raw_col != "auto":
        named = F.col("_h") == normalize_text(params.raw_col)
        if params.raw_col.isdigit():
            any_named = F.max(named.cast("int")).over(Window.partitionBy("file")) == 1
            named = F.when(any_named, named).otherwise(F.col("col") == int(params.raw_col))
        any_hit = F.max(named.cast("int")).over(Window.partitionBy("file")) == 1
        is_key = F.when(any_hit, named).otherwise(is_key)
    heads = heads.withColumn("_key", is_key)
    in_file = Window.partitionBy("file")
    by_col = in_file.orderBy("col")
    none = F.max(F.col("_key").cast("int")).over(in_file) == 0
    heads = heads.withColumn("_key", F.when(none, F.col("col") == 0).otherwise(F.col("_key")))
    if not params.multi_block:
        heads = heads.withColumn("_nth", F.sum(F.col("_key").cast("int")).over(by_col)) \
            .withColumn("_key", F.col("_key") & (F.col("_nth") == 1)).drop("_nth")
    # the block of a column is the number of key columns up to it
    heads = heads.withColumn("block", F.sum(F.col("_key").cast("int")).over(by_col)).where("block > 0")
    in_block = Window.partitionBy("file", "block")
    ends = heads.groupBy("file", "block").agg(
        F.min("col").alias("key_col"), F.max("col").alias("last_col"), F.first("header_row").alias("header_row"))
    chosen = ends
    taken = ["key_col"]
    requested = {"name": params.name_col, "unit": params.unit_col, "kind": params.kind_col, "note": params.note_col}
    scores = {f: hint_score("_h", FAMILIES[f]) for f in requested}
    options = heads.where(~F.col("_key")).select(
        "file", "block", "col", "fam", "unitish", "_h", *[s.alias(f"_s_{f}") for f, s in scores.items()])
    listed = options.groupBy("file", "block").agg(F.collect_list(F.struct(
        "col", "fam", "unitish", "_h", *[f"_s_{f}" for f in requested])).alias("_opts"))
    chosen = chosen.join(listed, ["file", "block"], "left").withColumn(
        "_opts", F.array_sort(F.coalesce("_opts", F.array().cast(listed.schema["_opts"].dataType))))
    for f in ("name", "unit", "kind", "note"):
        used = F.array_compact(F.array(*[F.col(c) for c in taken]))

        def first_col(test):
            return F.get(F.filter("_opts", test), F.lit(0))["col"]

        by_family = first_col(lambda o: (o["fam"] == f) & ~F.array_contains(used, o["col"]))
        by_score = F.array_max(F.transform(
            F.filter("_opts", lambda o: (o[f"_s_{f}"] > 0) & ~F.array_contains(used, o["col"])),
            lambda o: F.struct(o[f"_s_{f}"].alias("s"), (-o["col"]).alias("c"))))["c"] * -1
        pick = F.coalesce(by_family, by_score)
        if requested[f] and requested[f] != "auto":
            want = normalize_text(requested[f])
            pick = F.coalesce(first_col(lambda o: o["_h"] == want), pick)
        chosen = chosen.withColumn(f"{f}_col", pick)
        taken.append(f"{f}_col")
    # no name column: the one after the key; no unit column: the first that mostly holds units
    after = F.when(F.col("last_col") > F.col("key_col"), F.col("key_col") + 1).otherwise(F.col("key_col"))
    chosen = chosen.withColumn("name_col", F.coalesce("name_col", after))
    unit = F.get(F.filter("_opts", lambda o: (o["col"] != F.col("name_col")) & (o["unitish"] > 0.6)), F.lit(0))["col"]
    return chosen.withColumn("unit_col", F.coalesce("unit_col", unit)).drop("_opts")


def extract_entries(cells: DataFrame, params: DictionaryParams = DictionaryParams()) -> DataFrame:
    """Dictionary rows in load order: file, ord, key, name, unit, note, kind, shared."""
    parts = blocks(cells, params)
    body = cells.where(F.col("text").isNotNull() & (F.trim("text") != "")).join(parts, "file")
    body = body.where(
        (F.col("row") > F.col("header_row")) & F.col("col").between(F.col("key_col"), F.col("last_col")))

    def cell(c):
        return F.max(F.when(F.col("col") == F.col(c), F.trim("text")))

    # texts are aggregated by sorting: behind a shuffle, since before it a task may hold a whole table of cells
    rows = body.repartition("file", "block", "row").groupBy("file", "block", "row").agg(
        *[cell(f"{f}_col").alias(f) for f in ("key", "name", "unit", "kind", "note")])
    rows = rows.where(F.col("key").isNotNull())
    empty = F.lit("")
    unit = F.when(F.col("unit").isin(*NO_UNIT), empty).otherwise(F.coalesce("unit", empty))
    note = normalize(F.coalesce("note", empty))
    shared = F.lit(False)
    for marker in params.shared_markers:
        if normalize_text(marker):
            shared = shared | note.contains(normalize_text(marker))
    # block by block, each from top to bottom
    order = F.shiftleft(F.col("block").cast("long"), 40) + F.col("row")
    return rows.select("file", order.alias("ord"), "key", F.coalesce("name", empty).alias("name"), unit.alias("unit"),
                       F.coalesce("note", empty).alias("note"), F.coalesce("kind", empty).alias("kind"),
                       shared.alias("shared"))


def entries(rows: DataFrame) -> DataFrame:
    """Cleaned entries with their normalised key and name; a unit inside the name is split off."""
    key = F.trim("key")
    name = F.coalesce(F.nullif(F.trim(F.coalesce("name", F.lit(""))), F.lit("")), key)
    split = split_unit(name)
    empty = F.coalesce(F.col("unit"), F.lit("")) == ""
    out = rows.select(
        "file", "ord", key.alias("key"),
        F.when(empty, split["name"]).otherwise(name).alias("name"),
        F.when(empty, split["unit"]).otherwise(F.trim("unit")).alias("unit"),
        F.trim(F.coalesce("note", F.lit(""))).alias("note"), F.trim(F.coalesce("kind", F.lit(""))).alias("kind"),
        F.coalesce("shared", F.lit(False)).alias("shared")).where(key != "")
    return out.withColumn("norm_key", normalize("key")).withColumn("norm_name", normalize("name"))


ENTRY = ("name", "unit", "note", "kind", "shared")


def index(entry_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact and normalised index: file, lookup, ord, and the entry. The first entry of a lookup wins."""
    exact = entry_rows.groupBy("file", F.col("key").alias("lookup")).agg(
        F.min_by(F.struct("ord", *ENTRY), "ord").alias("entry"))
    both = entry_rows.select(
        "file", F.explode(F.array(
            F.struct(F.col("norm_key").alias("lookup"), (F.col("ord") * 2).alias("at")),
            F.struct(F.col("norm_name").alias("lookup"), (F.col("ord") * 2 + 1).alias("at")))).alias("_k"),
        "ord", *ENTRY)
    norm = both.groupBy("file", "_k.lookup").agg(
        F.min_by(F.struct(F.col("_k.at").alias("ord"), *ENTRY), "_k.at").alias("entry"))
    return exact, norm


def _grams(text: Column, size: int) -> Column:
    n = F.length(text)
    starts = F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))


def _holders(short: DataFrame, long: DataFrame, part: str, whole: str, size: int) -> DataFrame:
    """Pairs in which ``long.whole`` holds ``short.part``, of at least ``size`` characters: found by one anchor of each part,
    of its pieces of ``size`` characters the one that fewest wholes have. A whole that holds the part has all of its pieces."""
    pieces = long.select("file", whole, F.explode(F.array_distinct(_grams(F.col(whole), size))).alias("_piece")).distinct()
    often = pieces.groupBy("file", "_piece").agg(F.count(F.lit(1)).alias("_often"))
    own = short.where(F.length(part) >= size).select("file", part, F.explode(F.array_distinct(_grams(F.col(part), size))).alias("_piece")).distinct()
    # a part with a piece that no whole has is in none
    anchors = own.join(often, ["file", "_piece"], "left").groupBy("file", part).agg(
        F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), "_piece")).alias("_a")).where("_a.n > 0").select("file", part, F.col("_a._piece").alias("_piece"))
    return anchors.join(pieces, ["file", "_piece"]).where(F.col(whole).contains(F.col(part))).select("file", part, whole)


def substring_matches(headers: DataFrame, norm: DataFrame) -> DataFrame:
    """First entry whose text is inside the header or holds it: file, raw, entry.

    ``headers`` has file, raw and the normalised ``base``. Texts meet by one piece of
    the one that would be inside, so what is joined grows with the length of texts.
    """
    entries = norm.where(F.length("lookup") >= MIN_SUBSTRING)
    asked = headers.where(F.col("base") != "").select("file", "base").distinct()
    found = _holders(entries.select("file", "lookup"), asked, "lookup", "base", MIN_SUBSTRING)
    for size in range(1, MIN_SUBSTRING + 1):
        # a header of fewer characters is itself its only piece
        fits = F.length("base") == size if size < MIN_SUBSTRING else F.length("base") >= size
        found = found.unionByName(_holders(asked.where(fits), entries.select("file", "lookup"), "base", "lookup", size))
    first = found.join(entries.select("file", "lookup", "entry"), ["file", "lookup"]).groupBy("file", "base").agg(F.min_by("entry", "entry.ord").alias("entry"))
    return headers.select("file", "raw", "base").join(first, ["file", "base"]).select("file", "raw", "entry")


def fuzzy_matches(headers: DataFrame, norm: DataFrame, cutoff: float = 0.86) -> DataFrame:
    """Most similar entry of at least ``cutoff`` (above 0): file, raw, entry, ratio.

    Texts that may be that similar are found in memory, block by block (:mod:`fleetspark.operators.fuzzy`). At most
    (a + b) - 2 M characters of texts of a and b, of which M match, have to be taken out or put in, and changing one for another
    is cheaper still: edit distance, in the JVM, then leaves few pairs for the similarity itself.

    Texts are many times what the tables hold, which Spark's estimates do not know: no join of them is a broadcast. Starts jobs.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("the cutoff of similarity lies above 0 and up to 1")
    asked, known = headers.select("file", "raw", F.col("text").alias("x")), norm.where(F.length("lookup") > 0).select("file", F.col("lookup").alias("y"), "entry")
    texts = asked.select("file", F.lit(0).alias("side"), F.col("x").alias("t")).unionByName(
        known.select("file", F.lit(1).alias("side"), F.col("y").alias("t"))).where(F.length("t") > 0)
    pairs = candidates(texts.distinct().withColumn("n", F.length("t")), cutoff)
    near = pairs.where(F.levenshtein("x", "y") <= (F.length("x") + F.length("y")) * (1 - cutoff) + 1e-9)
    rated = stored(near.select("file", "x", "y", similarity("x", "y").alias("ratio")).where(F.col("ratio") >= cutoff))
    best = F.max_by(F.struct("entry", "ratio"), F.struct(F.col("ratio"), -F.col("entry.ord")))
    found = rated.join(known.hint("merge"), ["file", "y"]).groupBy("file", "x").agg(best.alias("_b"))
    return asked.join(found.hint("merge"), ["file", "x"]).select("file", "raw", "_b.entry", "_b.ratio")


def translate(headers: DataFrame, entry_rows: DataFrame, params: DictionaryParams = DictionaryParams()) -> DataFrame:
    """Headers with their entry by the first step that finds one.

    Steps: exact, normalised, without unit suffix, substring, fuzzy. Each works on
    the distinct headers the steps before left over. Result: file, raw, name, unit,
    note, kind, shared, matched, how.
    """
    # every step reads these again, so they are worked out once
    exact, norm = (sized(part) for part in index(sized(entry_rows)))
    split = split_unit("raw")
    asked = sized(
        headers.select("file", F.trim("raw").alias("raw")).distinct()
        .withColumn("_n", normalize("raw")).withColumn("_own_unit", split["unit"])
        .withColumn("_own_name", split["name"]).withColumn("base", normalize(split["name"]))
    )
    direct = (
        asked.join(exact.select("file", F.col("lookup").alias("raw"), F.col("entry").alias("_e1")), ["file", "raw"], "left")
        .join(norm.select("file", F.col("lookup").alias("_n"), F.col("entry").alias("_e2")), ["file", "_n"], "left")
        .join(norm.where("lookup <> ''").select("file", F.col("lookup").alias("base"), F.col("entry").alias("_e3")),
              ["file", "base"], "left")
    )
    left = direct.where("_e1 is null and _e2 is null and _e3 is null").select("file", "raw", "base", "_n")
    subs = sized(substring_matches(left, norm).withColumnRenamed("entry", "_e4"))
    still = left.join(subs.select("file", "raw"), ["file", "raw"], "left_anti").select(
        "file", "raw", F.coalesce(F.nullif("base", F.lit("")), "_n").alias("text"))
    fuzzy = fuzzy_matches(still, norm, params.fuzzy_cutoff).select("file", "raw", F.col("entry").alias("_e5"))
    found = direct.join(subs, ["file", "raw"], "left").join(fuzzy, ["file", "raw"], "left")
    steps = [f"_e{i}" for i in range(1, 6)]
    entry = F.coalesce(*steps)
    how = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(n)) for c, n in zip(
        steps, ("exact", "normalised", "without unit", "substring", "fuzzy"))])
    found = found.withColumn("_entry", entry).withColumn("how", how)
    own = F.coalesce(F.nullif("_own_name", F.lit("")), "raw")
    unit = F.when(F.col("_entry").isNull(), F.col("_own_unit")) \
        .when((F.col("how") == "without unit") & (F.col("_entry.unit") == ""), F.col("_own_unit")) \
        .otherwise(F.col("_entry.unit"))
    return found.select(
        "file", "raw", F.coalesce("_entry.name", own).alias("name"), unit.alias("unit"),
        *[F.coalesce(f"_entry.{c}", F.lit("")).alias(c) for c in ("note", "kind")],
        F.coalesce("_entry.shared", F.lit(False)).alias("shared"),
        F.col("_entry").isNotNull().alias("matched"), "how")


def unmatched(headers: DataFrame, translated: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Headers no step found, first seen first; ``skip`` (file, raw) lists time and alarm columns."""
    missing = translated.where(~F.col("matched")).select("file", "raw")
    seen = headers.select("file", F.trim("raw").alias("raw"), "pos").groupBy("file", "raw").agg(F.min("pos").alias("pos"))
    out = seen.join(missing, ["file", "raw"], "left_semi")
    return out if skip is None else out.join(skip, ["file", "raw"], "left_anti")


def build_channels(columns: DataFrame, translated: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One spec per raw header over all files: numeric in every file, unit row as a fallback, overrides last.

    ``columns``: file, file_pos, pos, raw, is_numeric, unit_row. ``translated`` is for
    one dictionary: raw and the entry. ``overrides``: raw, name, unit, note, include, decimals.
    """
    row_unit = F.trim(F.coalesce("unit_row", F.lit("")))
    given = (row_unit != "") & ~row_unit.isin(*NO_UNIT)
    order = F.struct("file_pos", "pos")
    merged = columns.groupBy("raw").agg(
        F.min(order).alias("_at"), F.bool_and("is_numeric").alias("is_numeric"),
        F.min_by(row_unit, F.when(given, order)).alias("_row_unit"))
    entry = translated.drop("file").dropDuplicates(["raw"])
    out = (
        merged.join(entry, "raw", "left")
        .withColumn("unit", F.coalesce(F.nullif("unit", F.lit("")), "_row_unit", F.lit("")))
        .withColumn("include", F.lit(True)).withColumn("decimals", F.lit(None).cast("int"))
    )
    if overrides is not None:
        given = overrides.select("raw", *[F.col(c).alias(f"_o_{c}") for c in ("name", "unit", "note", "include", "decimals")])
        out = out.join(given, "raw", "left")
        for c in ("name", "unit", "note", "include", "decimals"):
            out = out.withColumn(c, F.coalesce(f"_o_{c}", c)).drop(f"_o_{c}")
    return out.select(
        "raw", F.col("raw").alias("metric"), F.col("_at.file_pos").alias("file_pos"), F.col("_at.pos").alias("pos"),
        "name", "unit", "note", "kind", "shared", "is_numeric", "include", "decimals", "matched")
