"""Register records: resolving fields by priority, validating them, exporting templates.

A schema is rows of columns; it is small and checked to be, and reaches the
records as an array, so every record meets its columns without a join.  Answers,
free entries and derived values stay in their maps: an absent key reads as an
empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.codes import is_iso_date, is_lei
from lexweave.functions.text import csv_cell, without_corrigendum

MAX_COLUMNS = 10_000

# fixed values: two-letter country codes in use, with the two that official reporting adds
COUNTRIES = (
    "AD AE AF AG AI AL AM AO AQ AR AS AT AU AW AX AZ BA BB BD BE BF BG BH BI BJ BL BM BN BO BQ BR BS BT BV BW BY BZ "
    "CA CC CD CF CG CH CI CK CL CM CN CO CR CU CV CW CX CY CZ DE DJ DK DM DO DZ EC EE EG EH ER ES ET FI FJ FK FM FO FR "
    "GA GB GD GE GF GG GH GI GL GM GN GP GQ GR GS GT GU GW GY HK HM HN HR HT HU ID IE IL IM IN IO IQ IR IS IT JE JM JO JP "
    "KE KG KH KI KM KN KP KR KW KY KZ LA LB LC LI LK LR LS LT LU LV LY MA MC MD ME MF MG MH MK ML MM MN MO MP MQ MR MS MT "
    "MU MV MW MX MY MZ NA NC NE NF NG NI NL NO NP NR NU NZ OM PA PE PF PG PH PK PL PM PN PR PS PT PW PY QA RE RO RS RU RW "
    "SA SB SC SD SE SG SH SI SJ SK SL SM SN SO SR SS ST SV SX SY SZ TC TD TF TG TH TJ TK TL TM TN TO TR TT TV TW TZ UA UG "
    "UM US UY UZ VA VC VE VG VI VN VU WF WS YE YT ZA ZM ZW EL UK"
).split(" ")

SCHEMA_FIELDS = ("template_code", "code", "label", "soort", "instruction", "mandatory_raw", "mandatory", "fill_source", "ask_supplier")


def published_schema(roi_columns: DataFrame, lang: str = "nl") -> DataFrame:
    """One row a column code: the latest publication in a language; mandatory only where it is written exactly so."""
    latest = F.max_by(F.struct(*[c for c in SCHEMA_FIELDS if c != "code"]), F.struct("load_no", "col_row"))
    return roi_columns.filter((F.col("lang") == lang) & F.col("code").isNotNull()).groupBy("code").agg(latest.alias("s")).select("s.template_code", "code", *[f"s.{c}" for c in SCHEMA_FIELDS[2:5]], "s.mandatory_raw", F.coalesce(F.col("s.mandatory_raw") == "Verplicht", F.lit(False)).alias("mandatory"), "s.fill_source", "s.ask_supplier")


def schema_from_tables(tables: DataFrame) -> DataFrame:
    """Columns from instruction tables ``(template tables' cells)``: rows that lead with a full column code.

    ``tables(cells)``; a row is code, label, kind, instruction, obligation.
    """
    rows = tables.filter(without_corrigendum(F.element_at(F.element_at("cells", 1), 1)) == "Code kolom").select(F.explode("cells").alias("r")).withColumn("code", without_corrigendum(F.get("r", F.lit(0))))
    cell = lambda i: without_corrigendum(F.coalesce(F.get("r", F.lit(i)), F.lit("")))
    return rows.filter(F.col("code").rlike(r"\AB_\d{2}\.\d{2}\.\d{4}\z")).select(
        F.substring("code", 1, 7).alias("template_code"), "code", cell(1).alias("label"), cell(2).alias("soort"), cell(3).alias("instruction"), cell(4).alias("mandatory_raw"), (cell(4) == "Verplicht").alias("mandatory")
    )


def templates_from_tables(tables: DataFrame) -> DataFrame:
    """Templates from the overview table: code, name, description; other rows are no templates."""
    rows = tables.filter(F.trim(F.element_at(F.element_at("cells", 1), 1)) == "Code model").select(F.explode("cells").alias("r"))
    cell = lambda i: without_corrigendum(F.coalesce(F.get("r", F.lit(i)), F.lit("")))
    return rows.filter(cell(0).rlike(r"\AB_\d{2}\.\d{2}\z")).select(cell(0).alias("template_code"), cell(1).alias("name"), cell(2).alias("description"))


def schema_of_templates(columns: DataFrame, templates: DataFrame) -> DataFrame:
    """Columns whose template is in the overview."""
    return columns.join(templates.select("template_code"), "template_code", "left_semi")


def service_codes(table: DataFrame) -> DataFrame:
    """Codes with label and description from a table with a head; numbering before a label is dropped.

    ``table(cells)``, one row.
    """
    cell = lambda i: without_corrigendum(F.coalesce(F.get("r", F.lit(i)), F.lit("")))
    rows = table.select(F.explode(F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0)))).alias("r"))
    return rows.select(cell(0).alias("code"), F.regexp_replace(cell(1), r"\A\d+\.\s*", "").alias("label"), cell(2).alias("description"))


def lists_from_matrix(matrix: DataFrame) -> DataFrame:
    """Closed lists from ragged matrices ``(matrix_id, row_no, cells)``: full rows begin a list, shorter ones continue it.

    A matrix is one table of one document, its rows are put in order by its id;
    without a ``matrix_id`` there is one matrix.
    """
    if "matrix_id" not in matrix.columns:
        matrix = matrix.withColumn("matrix_id", F.lit(0))
    cells = F.transform("cells", lambda c: without_corrigendum(F.coalesce(c, F.lit(""))))
    rows = matrix.select("matrix_id", "row_no", cells.alias("c")).filter(F.get("c", F.lit(0)).startswith("B_99.01.R"))
    begins = (F.size("c") >= 4) & F.get("c", F.lit(1)).rlike(r"\AB_\d{2}\.\d{2}\.\d{4}\z")
    in_order = Window.partitionBy("matrix_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    code = F.last(F.when(begins, F.get("c", F.lit(1))), ignorenulls=True).over(in_order)
    option = F.when(begins, F.get("c", F.lit(3))).otherwise(F.get(F.filter(F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))), lambda x: x != ""), F.lit(0)))
    return rows.select("matrix_id", "row_no", code.alias("column_code"), option.alias("official_text")).filter("column_code IS NOT NULL AND coalesce(official_text, '') <> ''")


def overlay_source(columns: DataFrame, questions: DataFrame, automatic: list[str], asked: list[str]) -> DataFrame:
    """Where a column is filled from: a question, a derivation, the supplier, by hand – in this order."""
    by_question = questions.filter(F.col("column_code").rlike(r"\AB_\d{2}\.\d{2}\.\d{4}\z")).groupBy("column_code").agg(F.max_by("question_id", "pos").alias("q"))
    joined = columns.join(by_question, columns["code"] == by_question["column_code"], "left").drop("column_code")
    source = F.when(F.col("q").isNotNull(), F.concat(F.lit("assessment:"), "q")).when(F.col("code").isin(automatic), "auto").when(F.col("code").isin(asked), "supplier").otherwise("manual")
    return joined.withColumn("fill_source", source).withColumn("ask_supplier", F.col("code").isin(asked) & ~((F.col("q").isNull()) & F.col("code").isin(automatic))).drop("q")


def official_text(value: Column, options: Column) -> Column:
    """The first official text that begins with the value and a full stop; the value where none does."""
    return F.coalesce(F.get(F.filter(options, lambda o: o.startswith(F.concat(value, F.lit(".")))), F.lit(0)), value)


def bounded_schema(columns: DataFrame, max_columns: int = MAX_COLUMNS) -> list:
    rows = columns.orderBy("template_code", "code").limit(max_columns + 1).collect()
    if len(rows) > max_columns:
        raise ValueError(f"a schema of more than {max_columns} columns")
    return rows


def bounded_lists(closed_lists: DataFrame) -> dict[str, list[str]]:
    """Column code to official texts in order; the lists together are checked to be small."""
    rows = closed_lists.select("column_code", "item_no", "official_text").orderBy("column_code", "item_no").limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"closed lists of more than {MAX_COLUMNS} items")
    lists: dict[str, list[str]] = {}
    for r in rows:
        lists.setdefault(r["column_code"], []).append(r["official_text"])
    return lists


def list_map(closed_lists: DataFrame) -> Column:
    """The lists as a literal."""
    parts = [x for code, texts in bounded_lists(closed_lists).items() for x in (F.lit(code), F.array(*map(F.lit, texts)))]
    return F.create_map(*parts) if parts else F.create_map().cast("map<string,array<string>>")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _with_derived(records: DataFrame, derived: dict[str, Column] | None, key: str) -> tuple[DataFrame, dict[str, Column]]:
    """Records with the derived values as columns of their own, and these columns by column code."""
    names = {code: f"_d{i}" for i, code in enumerate(derived or {})}
    return records.select(key, "answers", "manual", *[v.alias(names[c]) for c, v in (derived or {}).items()]), {c: F.col(n) for c, n in names.items()}


def resolved(records: DataFrame, columns: DataFrame, closed_lists: DataFrame, derived: dict[str, Column] | None = None, key: str = "arr_row", templates: list[str] | None = None) -> DataFrame:
    """Every column of every record: by hand before answered before derived before empty.

    ``overridden`` where an entry by hand hides a different answer.  With
    ``templates`` only their columns are entered into the records.
    """
    rows, own = _with_derived(records, derived, key)
    lists = list_map(closed_lists)
    schema = [r for r in bounded_schema(columns) if templates is None or r["template_code"] in templates]
    kinds = {f.name: f.dataType for f in columns.schema}
    if not schema:
        return rows.select(key, *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()], F.lit("").alias("value"), F.lit("").alias("origin"), F.lit(False).alias("overridden")).limit(0)
    entered = rows.withColumn("c", F.explode(F.array(*[F.struct(*[F.lit(r[c]).cast(k).alias(c) for c, k in kinds.items()]) for r in schema])))
    source = F.col("c.fill_source")
    raw = _text(F.col("answers")[F.when(source.startswith("assessment:"), F.substring(source, F.lit(12), F.length(source)))])
    options = lists[F.col("c.code")]
    answered = F.when(raw.rlike(r"\AS\d{2}\z"), raw).when(options.isNotNull() & (raw != ""), official_text(raw, options)).when(raw == "ja", "Ja").when(raw == "nee", "Nee").when(raw == "nvt", "N.v.t.").otherwise(raw)
    auto = F.lit("")
    for code, value in own.items():
        auto = F.when(F.col("c.code") == code, _text(value)).otherwise(auto)
    parts = entered.select(key, "c.*", _text(F.col("manual")[F.col("c.code")]).alias("by_hand"), answered.alias("answered"), auto.alias("derived"))
    origin = F.when(F.col("by_hand") != "", "manual").when(F.col("answered") != "", "assessment").when(F.col("derived") != "", "auto").otherwise("leeg")
    value = F.when(F.col("by_hand") != "", F.col("by_hand")).when(F.col("answered") != "", F.col("answered")).otherwise(F.col("derived"))
    return parts.select(key, *columns.columns, value.alias("value"), origin.alias("origin"), ((F.col("by_hand") != "") & (F.col("answered") != "") & (F.col("by_hand") != F.col("answered"))).alias("overridden"))


def issue(value: Column, label: Column, soort: Column, mandatory: Column, options: Column | None = None) -> Column:
    """What is wrong with a value: the first of missing, LEI, country, date, amount, list; null if nothing.

    A LEI is checked only in alphanumeric columns whose label names one as a
    word, and only for values of 15 to 25 characters without blanks.
    """
    v = F.trim(F.coalesce(value, F.lit("")))
    lei_column = label.rlike(r"\bLEI\b") & (soort == "Alfanumeriek") & v.rlike(r"\A\S{15,25}\z")
    out = (
        F.when(v == "", F.when(mandatory, "ontbreekt"))
        .when(lei_column & ~is_lei(F.upper(v)), "fout:lei")
        .when((soort == "Land") & ~F.upper(v).isin(COUNTRIES), "fout:land")
        .when((soort == "Datum") & ~is_iso_date(v), "fout:datum")
        .when((soort == "Monetair") & ~v.rlike(r"\A\d+([.,]\d+)?\z"), "fout:monetair")
    )
    if options is not None:
        number = F.regexp_extract(v, r"\A(\d+)", 1)
        member = F.array_contains(options, v) | ((number != "") & F.exists(options, lambda o: o.startswith(F.concat(number, F.lit(".")))))
        out = out.when((F.size(options) > 0) & ~member, "fout:lijst")
    return out


def validated(fields: DataFrame, closed_lists: DataFrame) -> DataFrame:
    """Resolved fields with their issue."""
    options = list_map(closed_lists)[F.col("code")]
    return fields.withColumn("issue", issue(F.col("value"), F.coalesce("label", F.lit("")), F.coalesce("soort", F.lit("")), F.coalesce("mandatory", F.lit(False)), options))


def completeness(fields: DataFrame, by: list[str]) -> DataFrame:
    """Mandatory columns and how many of them hold a value, of resolved fields."""
    wanted = F.coalesce("mandatory", F.lit(False))
    return fields.groupBy(*by).agg(F.count_if(wanted & (F.trim("value") != "")).alias("filled"), F.count_if(wanted).alias("mandatory_total"))


def completeness_of_records(records: DataFrame, columns: DataFrame, derived: dict[str, Column] | None = None, key: str = "arr_row") -> DataFrame:
    """``key, template_code, filled, mandatory_total``: mandatory columns and how many of them hold a value.

    Counted inside each record's row, without a shuffle and without its texts: a
    value is blank where the entry that counts is, whatever official text an
    answer stands for.  A template without mandatory columns has 0 of 0.
    """
    rows, own = _with_derived(records, derived, key)
    auto = F.create_map(*[x for code, value in own.items() for x in (F.lit(code), value.cast("string"))]) if own else F.create_map().cast("map<string,string>")
    by_template: dict[str | None, list] = {}
    for r in bounded_schema(columns):
        by_template.setdefault(r["template_code"], []).append(r)

    def holds(c: Column) -> Column:
        hand, raw = _text(F.col("manual")[c["code"]]), _text(F.col("answers")[c["question"]])
        return F.trim(F.when(hand != "", hand).when(raw != "", raw).otherwise(_text(F.col("_auto")[c["code"]]))) != ""

    parts = []
    for template, rs in by_template.items():
        wanted = [(r["code"], (r["fill_source"] or "").removeprefix("assessment:") if (r["fill_source"] or "").startswith("assessment:") else "") for r in rs if r["mandatory"]]
        listed = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(q or None).cast("string").alias("question")) for c, q in wanted])
        filled = F.size(F.filter(listed, holds)) if wanted else F.lit(0)
        parts.append(F.struct(F.lit(template).cast("string").alias("template_code"), filled.cast("long").alias("filled"), F.lit(len(wanted)).cast("long").alias("mandatory_total")))
    rows = rows.withColumn("_auto", auto)
    if not parts:
        return rows.select(key, F.lit(None).cast("string").alias("template_code"), F.lit(0).cast("long").alias("filled"), F.lit(0).cast("long").alias("mandatory_total")).limit(0)
    return rows.select(key, F.explode(F.array(*parts)).alias("x")).select(key, "x.*")


def supplier_requests(fields: DataFrame, key: str = "arr_row") -> DataFrame:
    """Columns to ask of a supplier that are still empty."""
    return fields.filter(F.coalesce("ask_supplier", F.lit(False)) & (F.trim("value") == "")).select(key, "code", "label", "instruction", "mandatory_raw")


def template_lines(fields: DataFrame, template: str, key: str = "arr_row") -> DataFrame:
    """A template as CSV lines: codes, labels, then one line a record (line numbers order them within the file)."""
    return lines_of_templates(fields.filter(F.col("template_code") == template), key).drop("template_code")


def template_heads(columns: DataFrame, key: str = "arr_row") -> DataFrame:
    """The two head lines of every template from its columns alone, so a template without records has them too."""
    cells = columns.groupBy("template_code").agg(F.array_sort(F.collect_list(F.struct("code", "label"))).alias("x"))
    line = lambda name: F.array_join(F.transform("x", lambda c: csv_cell(c[name])), ",").alias("line")
    none = F.lit(None).cast("long").alias(key)
    return cells.select("template_code", F.lit(1).alias("part"), none, line("code")).unionByName(cells.select("template_code", F.lit(2).alias("part"), none, line("label")))


def lines_of_templates(fields: DataFrame, key: str = "arr_row") -> DataFrame:
    """Every template as in ``template_lines``, with its code."""
    cells = fields.groupBy("template_code", key).agg(F.array_sort(F.collect_list(F.struct("code", "label", "value"))).alias("x"))
    line = lambda name: F.array_join(F.transform("x", lambda c: csv_cell(c[name])), ",").alias("line")
    head = cells.groupBy("template_code").agg(F.min_by("x", key).alias("x"))
    none = F.lit(None).cast("long").alias(key)
    return (
        head.select("template_code", F.lit(1).alias("part"), none, line("code"))
        .unionByName(head.select("template_code", F.lit(2).alias("part"), none, line("label")))
        .unionByName(cells.select("template_code", F.lit(3).alias("part"), F.col(key).cast("long").alias(key), line("value")))
    )


def chain_lines(records: DataFrame, key: str = "arr_row", contract: str = "s1.1") -> DataFrame:
    """The supply-chain template: one line a link, the code type one of two."""
    rows = records.select(key, F.coalesce(F.col("answers")[contract], F.lit("")).alias("contract_ref"), F.posexplode("chain").alias("pos", "c")).filter("c IS NOT NULL")
    kind = F.when(F.col("c.code_type") == "euid", "EUID").otherwise("LEI")
    cells = [F.col("contract_ref"), F.col("c.service_type"), F.col("c.provider_code"), kind, F.col("c.chain_rank"), F.col("c.recipient_code")]
    return rows.select(key, "pos", F.concat_ws(",", *[csv_cell(c) for c in cells]).alias("line"))


def remapped(closed_lists: DataFrame, columns: DataFrame, renamed: dict[str, str]) -> DataFrame:
    """Lists under an old code moved to the new one, where the old code is no column and the new one is."""
    known = columns.select(F.col("code").alias("_code")).distinct()
    news = F.lit(None).cast("string")
    for old, new in renamed.items():
        news = F.when(F.col("column_code") == old, new).otherwise(news)
    rows = closed_lists.withColumn("_new", news)
    rows = rows.join(known.withColumn("_old_known", F.lit(True)), F.col("column_code") == F.col("_code"), "left").drop("_code").join(known.withColumn("_new_known", F.lit(True)), F.col("_new") == F.col("_code"), "left").drop("_code")
    return rows.withColumn("column_code", F.when(F.col("_old_known").isNull() & F.col("_new_known"), F.col("_new")).otherwise(F.col("column_code"))).select(closed_lists.columns)


def request_documents(requests: DataFrame, records: DataFrame, key: str = "arr_row") -> DataFrame:
    """One request a record as Markdown and as CSV, with the contract and the provider it concerns."""
    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    items = requests.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("code", "label", "mandatory_raw", "instruction"))).alias("x"))
    own = records.select(key, text(F.col("answers")["s1.1"]).alias("contract"), F.coalesce(F.nullif(text(F.col("answers")["s1.2"]), F.lit("")), "arr_name").alias("provider")).join(items, key)
    table = F.array_join(F.transform("x", lambda c: F.concat(F.lit("| "), c["code"], F.lit(" | "), text(c["label"]), F.lit(" | "), text(c["mandatory_raw"]), F.lit(" |"))), "\n")
    head = F.concat(F.lit("# Gegevensuitvraag – "), text(F.col("provider")), F.lit("\n\nContractreferentie: "), F.when(F.col("contract") == "", "—").otherwise(F.col("contract")), F.lit("\n\n| Veld | Omschrijving | Verplicht |\n| --- | --- | --- |\n"))
    lines = F.transform("x", lambda c: F.concat_ws(",", csv_cell(c["code"]), csv_cell(c["label"]), csv_cell(c["instruction"]), csv_cell(c["mandatory_raw"]), F.lit("")))
    return own.select(key, F.concat(head, table).alias("markdown"), F.array_join(F.concat(F.array(F.lit("Veld,Omschrijving,Instructie,Verplicht,Waarde")), lines), "\r\n").alias("csv"))


def csv_file(lines: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """One file's text (one a group ``by``): the lines joined by carriage return and line feed, none at the end.

    For files that fit a row, such as the columns of a template; lines of
    records are written by ``write_lines``, by many tasks.
    """
    return lines.groupBy(*(by or [])).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\r\n").alias("csv"))


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Lines as text files with carriage return and line feed, ordered over all files."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.option("lineSep", "\r\n").text(path)
