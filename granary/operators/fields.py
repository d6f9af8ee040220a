"""The catalog of published fields, and the scoring of header columns against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headers import equivalent_labels, folded, nfkc_parts, role_code, semantic_parts, semantics_of
from ..sources.work import written
from .listing import best

# Basis points for what speaks for a field, and what it takes to choose one unasked.
FULL_PATH, ALIAS, OVERLAP, TYPE, CONTEXT, ROLE, ROLE_OPEN, ROLE_CONFLICT = 7000, 4500, 3500, 1000, 2000, 1000, 500, -1000
LEAST, MARGIN, MOST, SHOWN = 8500, 1500, 10_000, 5
DEALS, BLOCK, BLOCKS = 16, 256, 16  #: parts that owners of equal bags are dealt to, owners of a small block, and such blocks of a group
PAIRS, TASKS = 1 << 25, (96, 8192)  #: pairs a task should make, and the fewest and most tasks for that


def parts(c: Column, least: int = 2, most: int = 1 << 20) -> Column:
    """The distinct substrings of c of least to most characters: a containment becomes an equality."""
    n = F.length(c)
    starts = F.when(n >= least, F.sequence(F.lit(1), n - least + 1)).otherwise(F.array().cast("array<int>"))
    of = lambda i: F.transform(F.sequence(F.lit(least), F.least(F.lit(most), n - i + 1)), lambda k: F.substring(c, i, k))
    return F.array_distinct(F.flatten(F.transform(starts, of)))


def joined_key(parts: Column) -> Column:
    """The label_key of a whole path, from its semantic_parts; NULL without any."""
    return F.nullif(F.array_join(F.transform(parts, lambda x: x["key"]), ""), F.lit(""))


def observed_type(kinds: Column) -> Column:
    """One type for the distinct kinds of a column's values: a lone kind, numbers together, else text; NULL without values."""
    numbers = F.forall(kinds, lambda k: k.isin("integer", "decimal"))
    return F.when(F.size(kinds) == 0, None).when(numbers, F.when(F.array_contains(kinds, "decimal"), "decimal").otherwise("integer")).when(F.size(kinds) == 1, kinds[0]).otherwise("text")


def field_catalog(fields: DataFrame, bindings: DataFrame) -> DataFrame:
    """fields: code, version, data_type, labels (names and aliases); bindings: code, path, domain, record_type, role.

    One row per field: code, version, data_type, aliases, full_paths, contexts, roles. Bindings of unknown fields are left out.
    """
    named = fields.select("code", F.explode_outer("labels").alias("label")).filter("label is not null and label <> ''")
    bound = bindings.select("code", "domain", "record_type", role_code(F.col("role")).alias("role"), semantic_parts(F.col("path")).alias("parts"))
    bound = bound.select("code", "domain", "record_type", "role", joined_key(F.col("parts")).alias("full"), F.try_element_at("parts", F.lit(-1))["part"].alias("leaf"))
    labels = named.unionByName(bound.filter("leaf is not null").select("code", F.col("leaf").alias("label"))).distinct()
    aliases = labels.select("code", F.explode(equivalent_labels(F.col("label"))).alias("alias")).groupBy("code").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    context = F.when((F.col("domain") != "") & (F.col("record_type") != ""), F.struct("domain", "record_type"))
    more = bound.groupBy("code").agg(F.array_sort(F.collect_set("full")).alias("full_paths"), F.array_sort(F.collect_set(context)).alias("contexts"), F.array_sort(F.collect_set("role")).alias("roles"))
    kinds = {"aliases": "array<string>", "full_paths": "array<string>", "contexts": "array<struct<domain:string,record_type:string>>", "roles": "array<string>"}
    joined = fields.select("code", "version", "data_type").join(aliases, "code", "left").join(more, "code", "left")
    return joined.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in kinds.items()})


def score_fields(columns: DataFrame, catalog: DataFrame) -> DataFrame:
    """columns: column_id, path, observed_type, domain, record_type. Candidates with score and reasons.

    Columns and fields meet by equal keys only: full path, leaf, base label, and every part of
    a leaf or an alias of two or more characters. Fields without any label in common, which
    could never be chosen, are no candidates.
    """
    forms = nfkc_parts(F.transform(F.coalesce("path", F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit(""))))
    clean = columns.select("column_id", "observed_type", "domain", "record_type", semantic_parts(F.col("path")).alias("parts"), forms.alias("forms"))
    meaning = semantics_of(F.when(F.size("parts") > 0, F.transform("parts", lambda x: x["form"])).otherwise(F.col("forms")))
    read = clean.select("column_id", "observed_type", "domain", "record_type", F.coalesce(joined_key(F.col("parts")), F.lit("")).alias("full"), F.coalesce(F.try_element_at("parts", F.lit(-1))["key"], F.lit("")).alias("leaf"), meaning.alias("s"))
    read = read.select("column_id", "observed_type", "domain", "record_type", "full", "leaf", F.col("s.base_key").alias("base"), F.col("s.role").alias("role"))
    alias = catalog.select("code", F.explode("aliases").alias("key"))
    path = catalog.select("code", F.explode("full_paths").alias("key"))
    by = lambda c, how: read.select("column_id", F.col(c).alias("key")).filter("key <> ''").select("column_id", "key", F.lit(how).alias("how"))
    meets = [
        by("full", "full_header_path").join(path, "key"),
        by("leaf", "published_alias").join(alias, "key"),
        by("base", "normalized_base_alias").join(alias, "key"),
        read.select("column_id", F.explode(parts(F.col("leaf"))).alias("key")).withColumn("how", F.lit("semantic_label_overlap")).join(alias.filter("length(key) >= 2"), "key"),
        read.select("column_id", F.col("leaf").alias("key")).filter("key <> ''").withColumn("how", F.lit("semantic_label_overlap")).join(alias.filter("length(key) >= 2").select("code", F.explode(parts(F.col("key"), 1)).alias("key")), "key"),
    ]
    met = meets[0]
    for m in meets[1:]:
        met = met.unionByName(m)
    points = F.create_map(*[F.lit(x) for pair in (("full_header_path", FULL_PATH), ("published_alias", ALIAS), ("normalized_base_alias", ALIAS - 1), ("semantic_label_overlap", OVERLAP)) for x in pair])
    labels = met.groupBy("column_id", "code").agg(F.max_by("how", points[F.col("how")]).alias("how"))  # the first of them counts
    both = labels.join(read, "column_id").join(catalog, "code")
    label = F.when(F.col("how") == "normalized_base_alias", ALIAS).otherwise(points[F.col("how")])
    number = ["integer", "decimal"]
    typed = F.coalesce((F.col("observed_type") == F.col("data_type")) | (F.col("observed_type").isin(number) & F.col("data_type").isin(number)), F.lit(False))
    context = F.coalesce((F.col("domain") != "") & (F.col("record_type") != "") & F.array_contains("contexts", F.struct("domain", "record_type")), F.lit(False))
    has, open_, fits = F.col("role").isNotNull(), F.size("roles") == 0, F.coalesce(F.array_contains("roles", F.col("role")), F.lit(False))
    role = F.when(~has, 0).when(fits, ROLE).when(open_, ROLE_OPEN).otherwise(ROLE_CONFLICT)
    score = F.least(F.lit(MOST), F.greatest(F.lit(0), label + F.when(typed, TYPE).otherwise(0) + F.when(context, CONTEXT).otherwise(0) + role))
    reasons = F.array_compact(F.array("how", F.when(typed, "data_type"), F.when(context, "region_context"), F.when(has & fits, "role").when(has & open_, "role_variant_candidate").when(has & ~fits, "role_conflict")))
    return both.select("column_id", "code", "version", score.cast("long").alias("score"), reasons.alias("reasons"), typed.alias("typed"), (F.col("observed_type").isNull() | typed).alias("type_open"))


def choose_fields(scored: DataFrame) -> DataFrame:
    """Per column: the leader, its score, margin, whether others tie with it, exact, and the first candidates.

    exact: a lone leader by its full path whose type fits, or by a label with score and margin enough.
    """
    w = Window.partitionBy("column_id").orderBy(F.col("score").desc(), "code")
    ranked = scored.withColumn("place", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("score").over(w), F.lit(0)))
    shown = ranked.filter(F.col("place") <= SHOWN).groupBy("column_id").agg(F.array_sort(F.collect_list(F.struct("place", "code", "version", "score", "reasons"))).alias("candidates"))
    top = ranked.filter("place = 1").withColumn("margin", F.col("score") - F.col("next")).withColumn("ambiguous", F.col("score") == F.col("next"))
    by_path = F.array_contains("reasons", "full_header_path")
    exact = ~F.col("ambiguous") & ((by_path & F.col("type_open")) | (~F.array_contains("reasons", "semantic_label_overlap") & (F.col("score") >= LEAST) & (F.col("margin") >= MARGIN)))
    return top.select("column_id", "code", "version", "score", "margin", "ambiguous", exact.alias("exact")).join(shown, "column_id")


def match_fields(columns: DataFrame, catalog: DataFrame, bound: DataFrame, ignored: DataFrame) -> DataFrame:
    """One row per column: column_id, code, version, score, matched_by.

    In order: unnamed columns and observed values are set aside; a column with a binding of its
    path in its template (bound: template_id, path_key, code, version; columns carry
    template_id) takes that field; an ignore rule for its path, context and type (ignored:
    path_key, domain, record_type, observed_type or NULL) sets it aside; the rest is scored.
    """
    keyed = columns.withColumn("path_key", joined_key(semantic_parts(F.col("path"))))
    direct = best(bound.select("template_id", "path_key", "code", "version"), ["template_id", "path_key"], [F.col("code"), F.col("version").desc()])
    rule = ignored.select("path_key", "domain", "record_type", F.col("observed_type").alias("only"))
    fits = F.col("r.only").isNull() | F.col("c.observed_type").isNull() | (F.col("r.only") == F.col("c.observed_type"))
    aside = keyed.alias("c").join(rule.alias("r"), (F.col("c.path_key") == F.col("r.path_key")) & (F.col("c.domain") == F.col("r.domain")) & (F.col("c.record_type") == F.col("r.record_type")) & fits, "left_semi").select("column_id", F.lit(True).alias("ruled"))
    state = keyed.join(direct, ["template_id", "path_key"], "left").join(aside, "column_id", "left")
    unnamed, bound_, ruled = F.col("path_key").isNull(), F.col("code").isNotNull(), F.col("ruled").isNotNull()
    how = F.when(unnamed, "auxiliary_column").when(bound_, "template_binding").when(ruled, "ignore_rule")
    state = state.withColumn("matched_by", how)
    open_ = state.filter("matched_by is null").select("column_id", "path", "observed_type", "domain", "record_type")
    chosen = choose_fields(score_fields(open_, catalog)).select("column_id", F.when(F.col("exact"), F.col("code")).alias("own"), F.when(F.col("exact"), F.col("version")).alias("own_version"), "score", "exact")
    full = state.join(chosen, "column_id", "left")
    settled = F.col("matched_by").isNotNull()
    return full.select(
        "column_id", F.when(settled, F.when(F.col("matched_by") == "template_binding", F.col("code"))).otherwise(F.col("own")).alias("code"), F.when(settled, F.when(F.col("matched_by") == "template_binding", F.col("version"))).otherwise(F.col("own_version")).alias("version"),
        F.when(settled, F.lit(MOST).cast("long")).otherwise(F.coalesce("score", F.lit(0))).alias("score"), F.coalesce("matched_by", F.when(F.col("exact"), "scored_exact").when(F.col("score") > 0, "scored_partial"), F.lit("none")).alias("matched_by"),
    )


def slot_coverage(slots: DataFrame, actual: DataFrame) -> DataFrame:
    """slots: template_id, slot_key, required; actual: template_id, source_id. Each actual region fills one slot of its template.

    One row per slot and per region left over: template_id, slot_key, source_id, state (filled, missing, optional, left_over).
    """
    n = lambda c: F.row_number().over(Window.partitionBy("template_id").orderBy(c)).alias("n")
    a, b = slots.select("*", n("slot_key")), actual.select("*", n("source_id"))
    both = a.join(b, ["template_id", "n"], "full")
    state = F.when(F.col("slot_key").isNull(), "left_over").when(F.col("source_id").isNotNull(), "filled").when(F.col("required"), "missing").otherwise("optional")
    return both.select("template_id", "slot_key", "source_id", state.alias("state"))


def same_fields(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, code; right_id, code. Pairs whose fields are equal as multisets; owners without any field have no pair.

    Owners of equal bags are dealt to DEALS parts by their id and cut into blocks there, the left ones into large blocks and the right ones
    into small ones, of which BLOCKS are held together. Each left block meets each such group once, and that meeting goes to a task of its own choice
    before pairs are made, so a bag of many owners is spread over tasks; what is shuffled is ids of blocks, never pairs. Pairs
    come block against block: the right ids of a small block stand again for every left one, which files hold in few bytes.

    Spark compiles a generator into one loop with what feeds it, and keeps all rows of that loop until it ends. So each step stands apart from
    the last, by the shuffle or by a coalesce that merges nothing, and holds the rows of one array only.
    """

    def blocks(df: DataFrame, key: str, most: int) -> DataFrame:
        owners = df.groupBy(key).agg(F.array_sort(F.collect_list("code")).alias("bag")).filter(F.size("bag") > 0)
        dealt = owners.withColumn("deal", F.pmod(F.xxhash64(key), F.lit(DEALS)).cast("int"))
        place = F.row_number().over(Window.partitionBy("bag", "deal").orderBy(key)) - 1
        return dealt.withColumn("block", F.floor(place / most)).groupBy("bag", "deal", "block").agg(F.flatten(F.collect_list(F.array(key))).alias(f"{key}s"))

    nth = F.row_number().over(Window.partitionBy("bag").orderBy("deal", "block")) - 1
    grouped = blocks(right, "right_id", BLOCK).withColumn("group", F.floor(nth / BLOCKS)).groupBy("bag", "group").agg(F.collect_list("right_ids").alias("right_blocks"))
    large, groups = written(blocks(left, "left_id", BLOCK * BLOCKS)), written(grouped)
    held = lambda df, ids, n: df.groupBy("bag").agg(F.sum(F.size(ids)).cast("double").alias(n))
    pairs = held(large, "left_ids", "n").join(held(groups, F.flatten("right_blocks"), "m"), "bag").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    # Tasks by the pairs, however few bytes they read, since these grow into pairs.
    tasks = int(min(max(pairs / PAIRS, TASKS[0]), TASKS[1]))
    met = large.join(groups, "bag").repartition(tasks, "bag", "deal", "block", "group")
    by_block = met.select("left_ids", F.explode("right_blocks").alias("right_ids")).coalesce(tasks)
    by_left = by_block.select(F.explode("left_ids").alias("left_id"), "right_ids").coalesce(tasks)
    return by_left.select("left_id", F.explode("right_ids").alias("right_id"))


def layout_snapshot(decisions: DataFrame) -> DataFrame:
    """decisions: sheet, signature, top, bottom, left, right (of the region), header_end, data_start, data_end, data_left, data_right, excluded (rows).

    The same as offsets, for another file of this layout. Ranges outside their region get no row.
    """
    inside = "data_start >= top and data_end <= bottom and data_end >= data_start and data_left >= left and data_right <= right and data_right >= data_left"
    return decisions.filter(inside).select(
        "sheet", "signature", (F.col("data_start") - F.col("header_end")).alias("start_offset"), (F.col("bottom") - F.col("data_end")).alias("end_gap"),
        (F.col("data_left") - F.col("left")).alias("left_offset"), (F.col("right") - F.col("data_right")).alias("right_gap"), F.transform("excluded", lambda r: r - F.col("data_start")).alias("excluded"),
    )


def project_layout(snapshot: DataFrame, headers: DataFrame) -> DataFrame:
    """Data ranges in other files. headers: workbook_id, sheet, signature, top, bottom, left, right, header_end.

    A header signature must be the sheet's only one of its kind, and the range valid; else state says why.
    """
    once = headers.withColumn("alike", F.count(F.lit(1)).over(Window.partitionBy("workbook_id", "sheet", "signature")))
    met = once.join(snapshot, ["sheet", "signature"])
    start, end = F.col("header_end") + F.col("start_offset"), F.col("bottom") - F.col("end_gap")
    state = F.when(F.col("alike") > 1, "ambiguous_header").when((start < F.col("top")) | (end > F.col("bottom")) | (start > end), "invalid_range").otherwise("projected")
    return met.select(
        "workbook_id", "sheet", "signature", start.alias("data_start"), end.alias("data_end"), (F.col("left") + F.col("left_offset")).alias("data_left"),
        (F.col("right") - F.col("right_gap")).alias("data_right"), F.transform("excluded", lambda o: o + start).alias("excluded"), state.alias("state"),
    ).distinct()


def header_fingerprint(paths: Column) -> Column:
    """A digest of a header's paths, for layouts of one kind."""
    return F.sha2(F.to_json(F.transform(paths, lambda p: F.transform(p, lambda x: folded(x)))), 256)


def region_signatures(headers: DataFrame) -> DataFrame:
    """headers: region_id, kind, paths (of its columns, in order). region_id, columns, header_depth, headers and fingerprint, which hangs on all but the kind.

    Columns whose path is a value, not a label, don't count.
    """
    each = headers.select("region_id", "kind", F.posexplode_outer("paths").alias("at", "path")).withColumn("path", semantic_parts(F.col("path")))
    kept = F.array_sort(F.collect_list(F.when(F.size("path") > 0, F.struct("at", "path"))))["path"]
    told = each.groupBy("region_id", "kind").agg(kept.alias("headers"))
    told = told.withColumns({"columns": F.size("headers"), "header_depth": F.coalesce(F.array_max(F.transform("headers", lambda p: F.size(p))), F.lit(0))})
    return told.select("region_id", "kind", "columns", "header_depth", "headers", F.sha2(F.to_json(F.struct("columns", "header_depth", "headers")), 256).alias("fingerprint"))


def layout_fingerprints(workbooks: DataFrame, sheets: DataFrame, regions: DataFrame) -> DataFrame:
    """workbook_id and fingerprint: the SHA-256 of a workbook's layout as JSON, whatever its cells below the headers hold.

    workbooks: workbook_id, format; sheets: workbook_id, sheet, hidden; regions: workbook_id, sheet, region, kind, width, header_rows, paths (of its
    header's columns). Regions are sorted by kind, width and depth within their sheet, sheets by their place, and all paths, as the file has
    them, white space aside.
    """
    one = F.struct(F.col("width").alias("columns"), F.col("header_rows").alias("header_depth"), "kind")
    ordered = F.array_sort(F.collect_list(F.struct("kind", "width", "header_rows", one.alias("r"))))["r"]
    per = regions.groupBy("workbook_id", "sheet").agg(ordered.alias("regions"))
    spaced_ = lambda p: F.filter(F.transform(p, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")
    paths = F.filter(F.transform("paths", spaced_), lambda p: F.size(p) > 0)
    heads = regions.groupBy("workbook_id").agg(F.array_sort(F.flatten(F.collect_list(paths))).alias("headers"))
    empty = F.array().cast(per.schema["regions"].dataType)
    sheet = F.struct("sheet", F.struct("hidden", F.coalesce("regions", empty).alias("regions")).alias("s"))
    whole = sheets.join(per, ["workbook_id", "sheet"], "left").groupBy("workbook_id").agg(F.array_sort(F.collect_list(sheet))["s"].alias("sheets"))
    full = workbooks.join(whole, "workbook_id", "left").join(heads, "workbook_id", "left")
    told = F.struct("format", F.coalesce("headers", F.array().cast("array<array<string>>")).alias("headers"), F.coalesce("sheets", F.array().cast(whole.schema["sheets"].dataType)).alias("sheets"))
    return full.select("workbook_id", F.sha2(F.to_json(told), 256).alias("fingerprint"))
