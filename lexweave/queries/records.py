"""Queries over records: questionnaires, registers, keyed state, streams, and plain relational extras."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.codes import is_lei
from lexweave.operators import register as G
from lexweave.operators import rules as R
from lexweave.operators import state as S
from lexweave.sources.tables import heavy_table, table
from lexweave.streaming import keyed

Q = R.Question
#: an example questionnaire over the answers of the register: four modules, four flags
MODULES = (
    R.Module("m1", (Q("s1.1", "Contract"), Q("s2.1", "Digitale dienst", effects=((("ja",), "digitaal"),)), Q("s5.1", "Kritieke functie", effects=((("ja", "JA"), "kritiek"),)), Q("s3.1", "Groep", effects=((("ja",), "groep"),)))),
    R.Module("m2", (Q("s4.2", "Uitbesteed", obligation=True, effects=((("ja",), "keten"),)), Q("s9.1", "Exitplan", obligation=True, show_if={"flag": "keten"})), {"flag": "digitaal"}),
    R.Module("m3", (Q("s11.1", "Vervangbaarheid", options=(("1", "Niet"), ("2", "Moeilijk"))), Q("s8.4", "Toetsing", obligation=True, show_if={"not": {"answer": {"q": "s11.1", "is": ["1", "2"]}}})), {"all": [{"flag": "digitaal"}, {"not": {"flag": "groep"}}]}),
    R.Module("m4", (Q("s7.2", "Kosten"), Q("s12.1", "Land", obligation=True)), {"any": [{"flag": "kritiek"}, {"answer": {"q": "s12.1", "is": "NL"}}]}),
)
DATES = [("2022-01-17", "inwerkingtreding", None), ("2025-04-30", "eerste opgave", "digitaal"), ("2024-07-22", "ketenregels", "kritiek"), ("2025-01-17", "toepassing", None)]


def _arrangements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "arrangements").filter("answers IS NOT NULL")


def _evaluated(spark, sf_dir):
    return R.evaluated(_arrangements(spark, sf_dir).select("arr_row", "answers"), MODULES)


def rule_visibility(spark, sf_dir):
    """Flags, visible modules and visible questions of each arrangement."""
    return _evaluated(spark, sf_dir).select("arr_row", F.array_join("flags", ",").alias("flags"), F.array_join("visible_modules", ",").alias("modules"), F.array_join("visible_questions", ",").alias("questions"))


def rule_obligations(spark, sf_dir):
    """Visible obligations with their status."""
    return R.obligations(_evaluated(spark, sf_dir), MODULES, "arr_row").select("arr_row", "module_id", "question_id", "status")


def rule_obligation_groups(spark, sf_dir):
    """Obligations per module: all, met, attention."""
    return R.obligation_groups(R.obligations(_evaluated(spark, sf_dir), MODULES, "arr_row"), ["module_id"])


def rule_progress(spark, sf_dir):
    """Answered and visible questions."""
    return R.progress(_evaluated(spark, sf_dir), MODULES, "arr_row")


def rule_first_incomplete(spark, sf_dir):
    """The first module that still needs an answer."""
    return R.first_incomplete_module(R.visible_questions(_evaluated(spark, sf_dir), MODULES, "arr_row"), "arr_row")


def rule_labels(spark, sf_dir):
    """Answers as their labels."""
    a = _arrangements(spark, sf_dir)
    return a.select("arr_row", R.answer_label(MODULES[2].questions[0], F.col("answers")["s11.1"]).alias("choice"), R.answer_label(MODULES[0].questions[1], F.col("answers")["s2.1"]).alias("yes_no"))


def rule_split(spark, sf_dir):
    """Obligations of the chain module beside all others."""
    inside, outside = R.split_by(R.obligations(_evaluated(spark, sf_dir), MODULES, "arr_row"), "module_id", ["m2"])
    return inside.agg(F.lit("keten").alias("part"), F.count("*").alias("n")).unionByName(outside.agg(F.lit("basis").alias("part"), F.count("*").alias("n")))


def regime_ladder(spark, sf_dir):
    """The first of three outcomes that holds for each arrangement."""
    steps = [({"not": {"flag": "digitaal"}}, "buiten bereik"), ({"all": [{"flag": "kritiek"}, {"flag": "keten"}]}, "volledig"), ({"any": [{"flag": "kritiek"}, {"answer": {"q": "s12.1", "is": ["NL", "BE"]}}]}, "beperkt")]
    return R.ladder(_evaluated(spark, sf_dir), steps, "licht").select("arr_row", "outcome")


def timeline(spark, sf_dir):
    """Dates that hold for each arrangement, in order."""
    return R.timeline(_evaluated(spark, sf_dir), DATES, "arr_row")


def _schema(spark, sf_dir):
    return G.published_schema(table(spark, sf_dir, "roi_columns"))


def register_schema(spark, sf_dir):
    """One row a column code: its latest publication."""
    return _schema(spark, sf_dir)


def _register(spark, sf_dir):
    """Records, columns, lists and derived values of the register."""
    records = heavy_table(spark, sf_dir, "arrangements", "arr_row", "answers", "manual")
    derived = {"B_21.01.0050": F.col("answers")["s1.1"], "B_22.01.0120": F.col("answers")["s1.3"]}
    return records, _schema(spark, sf_dir), table(spark, sf_dir, "closed_lists"), derived


def _fields(spark, sf_dir, templates=None):
    return G.resolved(*_register(spark, sf_dir), templates=templates)


def field_priority_resolve(spark, sf_dir):
    """Values per column and origin."""
    return _fields(spark, sf_dir).filter("value <> ''").groupBy("code", "origin").agg(F.count("*").alias("n"), F.min("value").alias("first_value"), F.count_if("overridden").alias("n_overridden"))


def field_validate(spark, sf_dir):
    """Issues per column."""
    return G.validated(_fields(spark, sf_dir), table(spark, sf_dir, "closed_lists")).filter("issue IS NOT NULL").groupBy("template_code", "code", "issue").agg(F.count("*").alias("n"))


def completeness(spark, sf_dir):
    """Mandatory columns filled per arrangement and template."""
    records, columns, _, derived = _register(spark, sf_dir)
    return G.completeness_of_records(records, columns, derived)


def supplier_request(spark, sf_dir):
    """Columns to ask of suppliers, per column."""
    return G.supplier_requests(_fields(spark, sf_dir)).groupBy("code", "label", "mandatory_raw").agg(F.count("*").alias("n_arrangements"))


def request_documents(spark, sf_dir):
    """Requests to suppliers as Markdown and CSV."""
    return G.request_documents(G.supplier_requests(_fields(spark, sf_dir)), table(spark, sf_dir, "arrangements").select("arr_row", "arr_name", "answers"))


def template_export(spark, sf_dir):
    """One template as CSV lines; ``template_export_all`` has all."""
    return G.template_lines(_fields(spark, sf_dir, ["B_21.01"]), "B_21.01")


def template_export_all(spark, sf_dir):
    """Every template as CSV lines."""
    return G.lines_of_templates(_fields(spark, sf_dir))


def chain_explode_rank(spark, sf_dir):
    """The supply-chain template's lines."""
    return G.chain_lines(_arrangements(spark, sf_dir))


def csv_document(spark, sf_dir):
    """The list of columns of one template as one CSV file; ``csv_document_all`` has all."""
    from lexweave.functions.text import csv_line

    rows = _schema(spark, sf_dir).filter("template_code = 'B_21.01'").select("code", csv_line(F.col("code"), F.col("label"), F.col("mandatory_raw")).alias("line"))
    return G.csv_file(rows, ["code"])


def csv_document_all(spark, sf_dir):
    """The list of columns of each template as one CSV file."""
    from lexweave.functions.text import csv_line

    rows = _schema(spark, sf_dir).select("template_code", "code", csv_line(F.col("code"), F.col("label"), F.col("mandatory_raw")).alias("line"))
    return G.csv_file(rows, ["code"], ["template_code"])


def closed_list_prefix(spark, sf_dir):
    """Bare numbers among free entries with the official text they begin."""
    entries = table(spark, sf_dir, "arrangements").select("arr_row", F.explode("manual").alias("code", "entry")).filter("entry rlike '^[0-9]{1,2}$'")
    options = G.list_map(table(spark, sf_dir, "closed_lists"))[F.col("code")]
    return entries.filter(options.isNotNull()).select("arr_row", "code", "entry", G.official_text(F.col("entry"), options).alias("official_text"))


def lei_mod97(spark, sf_dir):
    """Provider codes that are valid identifiers, per code type."""
    return table(spark, sf_dir, "chain_rows").groupBy("code_type").agg(F.count("*").alias("n"), F.count_if(is_lei(F.upper(F.trim("provider_code")))).alias("n_valid"))


_STATE = {"id": "arrangement_id", "name": "arr_name", "answers": "answers", "manual": "manual", "chain": "chain", "createdAt": "created_at", "updatedAt": "updated_at"}
_STATE_SCHEMA = "v int, arrangements array<struct<id string, name string, answers map<string,string>, manual map<string,string>, chain array<struct<id string, provider_code string, recipient_code string>>, createdAt long, updatedAt long>>"


def state_export(spark, sf_dir):
    """Arrangements exported as whole states in JSON and read back: every field of each."""
    out = S.exported(table(spark, sf_dir, "arrangements"), _STATE)
    back = S.with_version(out, "state_json", _STATE_SCHEMA).select("arr_row", F.col("state.arrangements")[0].alias("a"))
    entries = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("~")))), "|")
    chain = F.array_join(F.transform("a.chain", lambda c: F.coalesce(F.concat_ws(">", F.coalesce(c["provider_code"], F.lit("")), F.coalesce(c["recipient_code"], F.lit(""))), F.lit("~"))), "|")
    return back.select("arr_row", "a.id", "a.name", entries("a.answers").alias("answers"), entries("a.manual").alias("manual"), F.when(F.col("a.chain").isNotNull(), chain).alias("chain"), "a.createdAt", "a.updatedAt")


def _incoming(spark, sf_dir):
    """Files to import: whole states, of other versions, cut short, or of another shape."""
    a = S.exported(table(spark, sf_dir, "arrangements"), _STATE)
    raw = (
        F.when(F.col("arr_row") % 11 == 0, F.replace("state_json", F.lit('{"v":1'), F.lit('{"v":2'))).when(F.col("arr_row") % 13 == 0, F.substring("state_json", 1, 20)).when(F.col("arr_row") % 17 == 0, F.lit('{"v":1,"arrangements":{"id":"x"}}'))
        .when(F.col("arr_row") % 19 == 0, F.lit('{"v":1,"arrangements":[{"id":"a","name":"b","answers":{}},{"id":7,"name":"b","answers":{}},{"id":"c","name":"d","answers":null},null,{"id":"e","answers":{}}]}')).otherwise(F.col("state_json"))
    )
    return a.select("arr_row", raw.alias("raw"))


def import_result(spark, sf_dir):
    """How many records each file brings in; -1 for a file that is no state of the version."""
    return S.imported(_incoming(spark, sf_dir), "raw").select("arr_row", "n_imported", F.array_join(F.transform("records", lambda r: F.get_json_object(r, "$.id")), ",").alias("ids"))


def template_heads(spark, sf_dir):
    """The head lines of every template, of those without records too."""
    return G.template_heads(_schema(spark, sf_dir).unionByName(_schema(spark, sf_dir).limit(1).withColumn("template_code", F.lit("B_98.01")).withColumn("code", F.lit("B_98.01.0010")).withColumn("label", F.lit("a;b"))))


def _instruction_tables(spark, sf_dir):
    """The published columns as the tables of an annex: an overview, one instruction table a template with marks of corrections, and others."""
    c = _schema(spark, sf_dir).filter("label IS NOT NULL")
    code = F.when(F.col("code").endswith("50"), F.concat(F.lit("►C1 "), "code", F.lit(" ◄"))).otherwise(F.col("code"))
    row = F.array(code, F.concat(F.lit(" "), "label"), F.coalesce("soort", F.lit("")), F.coalesce("instruction", F.lit("")), F.coalesce("mandatory_raw", F.lit("")))
    head = F.array(*map(F.lit, ("Code kolom", "Naam", "Soort", "Instructie", "Keuze")))
    noise = F.array(F.lit("B_99.01.R0010"), F.lit("x"))
    tables = c.groupBy("template_code").agg(F.concat(F.array(head), F.array_sort(F.collect_list(row)), F.array(noise)).alias("cells"))
    overview = c.select("template_code").distinct().filter("template_code <> 'B_25.01'").agg(
        F.concat(F.array(F.array(F.lit("Code model"), F.lit("Naam"), F.lit("Beschrijving"))), F.array_sort(F.collect_list(F.array(F.col("template_code"), F.concat(F.lit("Model "), "template_code"), F.lit("Tekst ◄")))), F.array(F.array(F.lit("B_99"), F.lit(""), F.lit("")))).alias("cells")
    )
    return tables.select("cells").unionByName(overview)


def schema_derivation(spark, sf_dir):
    """Columns read from instruction tables, those of templates in the overview only."""
    tables = _instruction_tables(spark, sf_dir)
    return G.schema_of_templates(G.schema_from_tables(tables), G.templates_from_tables(tables))


def schema_templates(spark, sf_dir):
    """Templates read from the overview table."""
    return G.templates_from_tables(_instruction_tables(spark, sf_dir))


def closed_list_matrix(spark, sf_dir):
    """Closed lists read from ragged matrices: full rows begin a list, shorter ones continue it."""
    l = table(spark, sf_dir, "closed_lists")
    full = F.array(F.lit("B_99.01.R0010"), F.col("column_code"), F.col("column_label"), F.col("official_text"))
    short = F.array(F.lit("B_99.01.R0020"), F.lit(""), F.col("official_text"))
    rows = l.select(F.substring("column_code", 1, 7).alias("matrix_id"), F.concat("column_code", F.lpad(F.col("item_no").cast("string"), 5, "0")).alias("row_no"), F.when(F.col("item_no") == 1, full).otherwise(short).alias("cells"))
    other = rows.filter("row_no LIKE '%00001'").select("matrix_id", F.concat(F.lit("A"), "row_no").alias("row_no"), F.array(F.lit("kop"), F.lit("B_99.01.C0010")).alias("cells"))
    return G.lists_from_matrix(rows.unionByName(other)).select("column_code", "official_text")


def service_codes(spark, sf_dir):
    """Codes read from a table with a head, numbering before the labels dropped."""
    l = table(spark, sf_dir, "closed_lists").groupBy("column_code").agg(F.array_sort(F.collect_list(F.array(F.concat(F.lit("S"), F.lpad(F.col("item_no").cast("string"), 2, "0")), F.concat(F.col("item_no"), F.lit(". Dienst "), "item_no"), F.col("column_label")))).alias("r"))
    return G.service_codes(l.select(F.concat(F.array(F.array(F.lit("Code"), F.lit("Naam"), F.lit("Uitleg"))), "r").alias("cells")))


def fill_sources(spark, sf_dir):
    """Where each published column is filled from: a question before a derivation before the supplier before by hand."""
    c = _schema(spark, sf_dir).select("code", "label")
    questions = table(spark, sf_dir, "closed_lists").select(F.concat(F.lit("q-"), "column_code").alias("question_id"), "column_code", F.lit(1).alias("pos")).distinct().unionByName(
        spark.createDataFrame([("q-kapot", "geen code", 1)], "question_id string, column_code string, pos int")
    )
    return G.overlay_source(c, questions, ["B_21.01.0020", "B_21.01.0050", "B_22.01.0090"], ["B_22.01.0090", "B_22.01.0120", "B_21.01.0020"])


def remapped_lists(spark, sf_dir):
    """Lists under old numbers moved to the columns that replaced them, where these exist."""
    l = table(spark, sf_dir, "closed_lists")
    codes = [r["column_code"] for r in l.select("column_code").distinct().orderBy("column_code").limit(G.MAX_COLUMNS).collect()]
    old = l.withColumn("column_code", F.regexp_replace("column_code", r"\AB_", "X_"))
    columns = l.select(F.col("column_code").alias("code")).distinct().filter("code <> 'B_21.01.0020'")
    return G.remapped(old, columns, {f"X_{c[2:]}": c for c in codes}).select("column_code", "item_no", "official_text")


def rule_derived_flags(spark, sf_dir):
    """Flags derived from flags: one that holds with two others, one that ends up known only after the last question."""
    derive = lambda flags: {"zwaar": flags.get("digitaal", F.lit(False)) & flags.get("kritiek", F.lit(False)), "licht": ~flags.get("keten", F.lit(False))}
    return R.evaluated(_arrangements(spark, sf_dir).select("arr_row", "answers"), MODULES, derive=derive).select("arr_row", F.array_join("flags", ",").alias("flags"))


def rule_column_questions(spark, sf_dir):
    """Visible questions that fill a column of the register, and their answers."""
    codes = {"s1.1": "B_21.01.0010", "s4.2": "B_22.01.0020", "s12.1": "B_23.01.0030"}
    modules = tuple(R.Module(m.id, tuple(replace(q, column_code=codes.get(q.id)) for q in m.questions), m.show_if) for m in MODULES)
    e = R.evaluated(_arrangements(spark, sf_dir).select("arr_row", "answers"), modules)
    return R.column_answers(e, modules, "arr_row")


def stream_windowed_counts(spark, sf_dir):
    """Events per hour and kind from a stream whose windows stay open long enough."""
    stream = keyed.windowed_counts(keyed.file_stream(spark, f"{sf_dir}/events.parquet"), "ts", "event_type", lateness="20000 days")
    return keyed.run_available(stream, "complete")


def versioned_state(spark, sf_dir):
    """Stored states of the known version; others count as none."""
    raw = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"v":'), F.col("event_id") % 3, F.lit(',"value":'), F.col("value").cast("decimal(12,2)"), F.when(F.col("event_id") % 7 == 0, "").otherwise("}")).alias("raw"))
    return S.with_version(raw, "raw", "v int, value decimal(12,2)").select("event_id", F.col("state.value").alias("value"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def latest_per_key(spark, sf_dir):
    """The last value of each user and kind."""
    return S.latest(_events(spark, sf_dir), ["user_id", "event_type"], "value", ["ts", "event_id"])


def latest_without_blank(spark, sf_dir):
    """Last manual entries of each arrangement and column, blank ones cleared."""
    rows = table(spark, sf_dir, "arrangements").select("arrangement_id", "arr_row", F.explode("manual").alias("code", "entry"))
    return S.without_blank(S.latest(rows, ["arrangement_id", "code"], "entry", ["arr_row"]), "entry")


def alive_keys(spark, sf_dir):
    """Users whose last event is no error."""
    return S.alive(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")


def toggle_parity(spark, sf_dir):
    """Users and kinds switched an odd number of times."""
    return S.toggled(_events(spark, sf_dir), ["user_id", "event_type"], "ts")


def bulk_reset(spark, sf_dir):
    """Switched keys without those of users who signed up an even number of times."""
    e = _events(spark, sf_dir)
    even = e.filter("event_type = 'signup'").groupBy("user_id").count().filter("count % 2 = 0")
    return S.reset(S.toggled(e, ["user_id", "event_type"], "ts"), even, ["user_id"])


def lru8_recent(spark, sf_dir):
    """The eight items each kind visited last."""
    e = _events(spark, sf_dir).withColumn("item", F.get_json_object("props", "$.k"))
    return S.most_recent(e, "event_type", "item", "ts")


def lru8_with_closes(spark, sf_dir):
    """The list of each user after visits and closings."""
    e = _events(spark, sf_dir).withColumn("item", F.get_json_object("props", "$.k"))
    return S.bounded_lists(e, "user_id", "item", "ts", F.col("event_type") == "error", "event_id")


def merge_import(spark, sf_dir):
    """Arrangements with a later delivery put over them."""
    rows = table(spark, sf_dir, "arrangements").select("arrangement_id", "arr_row", "arr_name", "load_no")
    last = lambda df: df.groupBy("arrangement_id").agg(F.max_by(F.struct("arr_row", "arr_name", "load_no"), "arr_row").alias("x")).select("arrangement_id", "x.*")
    return S.merged(last(rows.filter("load_no <= 6")), last(rows.filter("load_no > 6")), "arrangement_id", F.col("arr_name").isNotNull())


def stream_latest_per_key(spark, sf_dir):
    """The same last values from a stream of files."""
    return keyed.run_available(keyed.latest(keyed.file_stream(spark, f"{sf_dir}/events.parquet"), ["user_id", "event_type"], "value", ["ts", "event_id"]))


def stream_toggle_parity(spark, sf_dir):
    """The same switched keys from a stream of files."""
    return keyed.run_available(keyed.toggled(keyed.file_stream(spark, f"{sf_dir}/events.parquet"), ["user_id", "event_type"], "ts"))


def stream_bounded_lists(spark, sf_dir):
    """The same lists from a stream with state per user, of files that arrive in order of time."""
    s = keyed.file_stream(spark, f"{sf_dir}/events.parquet").withColumn("item", F.get_json_object("props", "$.k")).withColumn("closed", F.col("event_type") == "error")
    return keyed.last_lists(keyed.bounded_lists(s, "user_id", "item", "ts", "closed")).select(F.col("owner").alias("user_id"), "place", "item", "last_at")


def extra_rollup(spark, sf_dir):
    """Beyond the reference: line items rolled up by flag and status."""
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def extra_cube(spark, sf_dir):
    """Beyond the reference: events by kind and weekday."""
    return _events(spark, sf_dir).withColumn("weekday", F.weekday("ts")).cube("event_type", "weekday").agg(F.count("*").alias("n"))


def extra_full_outer(spark, sf_dir):
    """Beyond the reference: customers and suppliers of each nation."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_customers"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_suppliers"))
    return c.join(s, "nation", "full_outer")


def extra_intersect(spark, sf_dir):
    """Beyond the reference: nations with customers and suppliers."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


def extra_window(spark, sf_dir):
    """Beyond the reference: events per hour and kind."""
    return _events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


QUERIES = {
    f.__name__: f
    for f in (
        rule_visibility, rule_obligations, rule_obligation_groups, rule_progress, rule_first_incomplete, rule_labels, rule_split, regime_ladder, timeline, register_schema, field_priority_resolve, field_validate, completeness,
        supplier_request, request_documents, template_export, template_export_all, chain_explode_rank, csv_document, csv_document_all, template_heads, schema_derivation, schema_templates, closed_list_matrix, service_codes, fill_sources, remapped_lists, rule_derived_flags, rule_column_questions, closed_list_prefix, lei_mod97, state_export, import_result, versioned_state, latest_per_key, latest_without_blank, alive_keys, toggle_parity, bulk_reset, lru8_recent,
        lru8_with_closes, merge_import, stream_latest_per_key, stream_toggle_parity, stream_bounded_lists, stream_windowed_counts, extra_rollup, extra_cube, extra_full_outer, extra_intersect, extra_window,
    )
}

_A = "a AS (SELECT arr_row, answers['s1.1'] AS q11, answers['s2.1'] AS q21, answers['s5.1'] AS q51, answers['s3.1'] AS q31, answers['s4.2'] AS q42, answers['s9.1'] AS q91, answers['s11.1'] AS q111, answers['s8.4'] AS q84, answers['s7.2'] AS q72, answers['s12.1'] AS q121 FROM arrangements WHERE answers IS NOT NULL)"
_V = f"""WITH {_A},
f AS (SELECT *, coalesce(q21 = 'ja', false) AS digitaal, coalesce(q51 IN ('ja', 'JA'), false) AS kritiek, coalesce(q31 = 'ja', false) AS groep FROM a),
g AS (SELECT *, digitaal AND coalesce(q42 = 'ja', false) AS keten, digitaal AS m2, digitaal AND NOT groep AS m3, kritiek OR coalesce(q121 = 'NL', false) AS m4 FROM f),
q AS (SELECT arr_row, unnest([
  {{'m': 'm1', 'q': 's1.1', 'v': true, 'a': q11, 'o': false, 'p': 0}}, {{'m': 'm1', 'q': 's2.1', 'v': true, 'a': q21, 'o': false, 'p': 1}}, {{'m': 'm1', 'q': 's5.1', 'v': true, 'a': q51, 'o': false, 'p': 2}}, {{'m': 'm1', 'q': 's3.1', 'v': true, 'a': q31, 'o': false, 'p': 3}},
  {{'m': 'm2', 'q': 's4.2', 'v': m2, 'a': q42, 'o': true, 'p': 4}}, {{'m': 'm2', 'q': 's9.1', 'v': m2 AND keten, 'a': q91, 'o': true, 'p': 5}}, {{'m': 'm3', 'q': 's11.1', 'v': m3, 'a': q111, 'o': false, 'p': 6}},
  {{'m': 'm3', 'q': 's8.4', 'v': m3 AND NOT coalesce(q111 IN ('1', '2'), false), 'a': q84, 'o': true, 'p': 7}}, {{'m': 'm4', 'q': 's7.2', 'v': m4, 'a': q72, 'o': false, 'p': 8}}, {{'m': 'm4', 'q': 's12.1', 'v': m4, 'a': q121, 'o': true, 'p': 9}}]) AS x FROM g),
v AS (SELECT arr_row, x.m AS module_id, x.q AS question_id, x.a AS answer, x.o AS obligation, x.p AS pos FROM q WHERE x.v),
ob AS (SELECT arr_row, module_id, question_id, CASE answer WHEN 'ja' THEN 'voldaan' WHEN 'nee' THEN 'actie' WHEN 'nvt' THEN 'nvt' ELSE 'open' END AS status FROM v WHERE obligation)
"""
_COLS = """s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY load_no DESC, col_row DESC) AS k FROM roi_columns WHERE lang = 'nl' AND code IS NOT NULL) WHERE k = 1),
c AS (SELECT template_code, code, label, soort, instruction, mandatory_raw, coalesce(mandatory_raw = 'Verplicht', false) AS mandatory, fill_source, ask_supplier FROM s)"""
_FIELDS = f"""WITH {_COLS},
lists AS (SELECT column_code, list(official_text ORDER BY item_no) AS options FROM closed_lists GROUP BY 1),
r AS (SELECT a.arr_row, c.*, l.options, coalesce(a.manual[c.code], '') AS hand, coalesce(a.answers[CASE WHEN starts_with(c.fill_source, 'assessment:') THEN substring(c.fill_source, 12) END], '') AS raw,
  coalesce(CASE c.code WHEN 'B_21.01.0050' THEN a.answers['s1.1'] WHEN 'B_22.01.0120' THEN a.answers['s1.3'] END, '') AS auto FROM arrangements a CROSS JOIN c LEFT JOIN lists l ON l.column_code = c.code),
w AS (SELECT *, CASE WHEN regexp_full_match(raw, 'S[0-9]{{2}}') THEN raw WHEN options IS NOT NULL AND raw <> '' THEN coalesce(list_filter(options, lambda o: starts_with(o, raw || '.'))[1], raw) WHEN raw = 'ja' THEN 'Ja' WHEN raw = 'nee' THEN 'Nee' WHEN raw = 'nvt' THEN 'N.v.t.' ELSE raw END AS ans FROM r),
fields AS (SELECT *, CASE WHEN hand <> '' THEN hand WHEN ans <> '' THEN ans ELSE auto END AS value, CASE WHEN hand <> '' THEN 'manual' WHEN ans <> '' THEN 'assessment' WHEN auto <> '' THEN 'auto' ELSE 'leeg' END AS origin, hand <> '' AND ans <> '' AND hand <> ans AS overridden FROM w)
"""
_LEI = "CASE WHEN regexp_full_match({c}, '[A-Z0-9]{{18}}[0-9]{{2}}') THEN CAST(list_aggregate(list_transform(regexp_split_to_array({c}, ''), lambda x: CASE WHEN x BETWEEN 'A' AND 'Z' THEN CAST(ascii(x) - 55 AS VARCHAR) ELSE x END), 'string_agg', '') AS HUGEINT) % 97 = 1 ELSE false END"
_LEI_UP = _LEI.format(c="upper(trim(value, ' '))")
_LEI_PROVIDER = _LEI.format(c="upper(trim(coalesce(provider_code, ''), ' '))")
_CSV = "CASE WHEN regexp_matches(coalesce({c}, ''), '[\",\\n;]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE coalesce({c}, '') END"
_COUNTRY_LIST = ", ".join(f"'{c}'" for c in G.COUNTRIES)
_ITEM = "json_extract_string(props, '$.k')"
_LATEST = "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS n_events FROM events GROUP BY ALL"
_TOGGLED = "SELECT user_id, event_type, max(ts) AS since FROM events GROUP BY ALL HAVING count(*) % 2 = 1"

SQL = {
    "rule_visibility": _V + """SELECT g.arr_row, array_to_string(list_sort(list_filter([CASE WHEN digitaal THEN 'digitaal' END, CASE WHEN groep THEN 'groep' END, CASE WHEN keten THEN 'keten' END, CASE WHEN kritiek THEN 'kritiek' END], lambda x: x IS NOT NULL)), ',') AS flags,
  array_to_string(list_filter(['m1', CASE WHEN m2 THEN 'm2' END, CASE WHEN m3 THEN 'm3' END, CASE WHEN m4 THEN 'm4' END], lambda x: x IS NOT NULL), ',') AS modules, (SELECT string_agg(question_id, ',' ORDER BY pos) FROM v WHERE v.arr_row = g.arr_row) AS questions FROM g""",
    "rule_obligations": _V + "SELECT * FROM ob",
    "rule_obligation_groups": _V + "SELECT module_id, count(*) AS n_obligations, count(*) FILTER (status = 'voldaan') AS n_met, bool_or(status IN ('actie', 'open')) AS needs_attention FROM ob GROUP BY module_id",
    "rule_progress": _V + "SELECT arr_row, CAST(count(*) FILTER (coalesce(answer, '') <> '') AS INTEGER) AS answered, CAST(count(*) AS INTEGER) AS total FROM v GROUP BY arr_row",
    "rule_first_incomplete": _V + "SELECT arr_row, arg_min(module_id, pos) AS module_id FROM v WHERE coalesce(answer, '') = '' GROUP BY arr_row",
    "rule_labels": f"WITH {_A} SELECT arr_row, coalesce(CASE q111 WHEN '1' THEN 'Niet' WHEN '2' THEN 'Moeilijk' ELSE q111 END, '') AS choice, coalesce(CASE q21 WHEN 'ja' THEN 'Ja' WHEN 'nee' THEN 'Nee' WHEN 'nvt' THEN 'N.v.t.' ELSE q21 END, '') AS yes_no FROM a",
    "rule_split": _V + "SELECT 'keten' AS part, count(*) AS n FROM ob WHERE module_id = 'm2' UNION ALL SELECT 'basis', count(*) FROM ob WHERE module_id <> 'm2'",
    "regime_ladder": _V + "SELECT arr_row, CASE WHEN NOT digitaal THEN 'buiten bereik' WHEN kritiek AND keten THEN 'volledig' WHEN kritiek OR coalesce(q121 IN ('NL', 'BE'), false) THEN 'beperkt' ELSE 'licht' END AS outcome FROM g",
    "timeline": _V + "SELECT arr_row, CAST(row_number() OVER (PARTITION BY arr_row ORDER BY day, pos) - 1 AS INTEGER) AS place, day, label FROM g, (VALUES ('2022-01-17', 0, 'inwerkingtreding', NULL), ('2025-04-30', 1, 'eerste opgave', 'digitaal'), ('2024-07-22', 2, 'ketenregels', 'kritiek'), ('2025-01-17', 3, 'toepassing', NULL)) t(day, pos, label, flag) WHERE flag IS NULL OR (flag = 'digitaal' AND digitaal) OR (flag = 'kritiek' AND kritiek)",
    "register_schema": f"WITH {_COLS} SELECT * FROM c",
    "field_priority_resolve": _FIELDS + "SELECT code, origin, count(*) AS n, min(value) AS first_value, count(*) FILTER (overridden) AS n_overridden FROM fields WHERE value <> '' GROUP BY ALL",
    "field_validate": _FIELDS + f""", i AS (SELECT template_code, code, CASE WHEN trim(value, ' ') = '' THEN CASE WHEN mandatory THEN 'ontbreekt' END
  WHEN regexp_matches(coalesce(label, ''), '\\bLEI\\b') AND soort = 'Alfanumeriek' AND regexp_full_match(trim(value, ' '), '\\S{{15,25}}') AND NOT {_LEI_UP} THEN 'fout:lei'
  WHEN soort = 'Land' AND upper(trim(value, ' ')) NOT IN ({_COUNTRY_LIST}) THEN 'fout:land' WHEN soort = 'Datum' AND NOT (regexp_full_match(trim(value, ' '), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST(trim(value, ' ') AS DATE) IS NOT NULL) THEN 'fout:datum'
  WHEN soort = 'Monetair' AND NOT regexp_full_match(trim(value, ' '), '[0-9]+([.,][0-9]+)?') THEN 'fout:monetair'
  WHEN len(options) > 0 AND NOT (list_contains(options, trim(value, ' ')) OR (regexp_extract(trim(value, ' '), '^[0-9]+') <> '' AND len(list_filter(options, lambda o: starts_with(o, regexp_extract(trim(value, ' '), '^[0-9]+') || '.'))) > 0)) THEN 'fout:lijst' END AS issue FROM fields)
SELECT template_code, code, issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY ALL""",
    "completeness": _FIELDS + "SELECT arr_row, template_code, count(*) FILTER (mandatory AND trim(value, ' ') <> '') AS filled, count(*) FILTER (mandatory) AS mandatory_total FROM fields GROUP BY ALL",
    "supplier_request": _FIELDS + "SELECT code, label, mandatory_raw, count(*) AS n_arrangements FROM fields WHERE coalesce(ask_supplier, false) AND trim(value, ' ') = '' GROUP BY ALL",
    "template_export": _FIELDS + f""", t AS (SELECT * FROM fields WHERE template_code = 'B_21.01'), h AS (SELECT DISTINCT code, label FROM t)
SELECT 1 AS part, CAST(NULL AS BIGINT) AS arr_row, string_agg({_CSV.format(c="code")}, ',' ORDER BY code) AS line FROM h UNION ALL SELECT 2, NULL, string_agg({_CSV.format(c="label")}, ',' ORDER BY code) FROM h UNION ALL SELECT 3, arr_row, string_agg({_CSV.format(c="value")}, ',' ORDER BY code) FROM t GROUP BY arr_row""",
    "chain_explode_rank": f"""WITH x AS (SELECT arr_row, coalesce(answers['s1.1'], '') AS ref, unnest(chain) AS c, generate_subscripts(chain, 1) - 1 AS pos FROM arrangements WHERE answers IS NOT NULL)
SELECT arr_row, CAST(pos AS INTEGER) AS pos, {_CSV.format(c='ref')} || ',' || {_CSV.format(c='c.service_type')} || ',' || {_CSV.format(c='c.provider_code')} || ',' || CASE WHEN c.code_type = 'euid' THEN 'EUID' ELSE 'LEI' END || ',' || {_CSV.format(c='c.chain_rank')} || ',' || {_CSV.format(c='c.recipient_code')} AS line FROM x WHERE c IS NOT NULL""",
    "csv_document": f"WITH {_COLS} SELECT string_agg({_CSV.format(c='code')} || ',' || {_CSV.format(c='label')} || ',' || {_CSV.format(c='mandatory_raw')}, chr(13) || chr(10) ORDER BY code) AS csv FROM c WHERE template_code = 'B_21.01'",
    "closed_list_prefix": "WITH e AS (SELECT arr_row, unnest(map_entries(manual)) AS e FROM arrangements), x AS (SELECT arr_row, e.key AS code, e.value AS entry FROM e WHERE regexp_full_match(e.value, '[0-9]{1,2}') AND e.key IN (SELECT column_code FROM closed_lists)) SELECT arr_row, code, entry, coalesce((SELECT arg_min(official_text, item_no) FROM closed_lists WHERE column_code = code AND starts_with(official_text, entry || '.')), entry) AS official_text FROM x",
    "lei_mod97": f"SELECT code_type, count(*) AS n, count(*) FILTER ({_LEI_PROVIDER}) AS n_valid FROM chain_rows GROUP BY code_type",
    "versioned_state": "SELECT event_id, CAST(value AS DECIMAL(12,2)) AS value FROM events WHERE event_id % 3 = 1 AND event_id % 7 <> 0",
    "latest_per_key": _LATEST,
    "latest_without_blank": "WITH e AS (SELECT arrangement_id, arr_row, unnest(map_entries(manual)) AS e FROM arrangements), x AS (SELECT arrangement_id, e.key AS code, e.value AS entry, row_number() OVER (PARTITION BY arrangement_id, e.key ORDER BY arr_row DESC) AS k, count(*) OVER (PARTITION BY arrangement_id, e.key) AS n_events FROM e) SELECT arrangement_id, code, entry, n_events FROM x WHERE k = 1 AND trim(coalesce(entry, ''), ' ') <> ''",
    "alive_keys": "SELECT user_id FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) <> 'error'",
    "toggle_parity": _TOGGLED,
    "bulk_reset": f"SELECT * FROM ({_TOGGLED}) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' GROUP BY user_id HAVING count(*) % 2 = 0)",
    "lru8_recent": f"SELECT event_type, item, last_at, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY last_at DESC, item) AS k FROM (SELECT event_type, {_ITEM} AS item, max(ts) AS last_at FROM events GROUP BY ALL)) WHERE k <= 8",
    "merge_import": "WITH a AS (SELECT arrangement_id, arr_row, arr_name, load_no, load_no > 6 AS late, row_number() OVER (PARTITION BY arrangement_id, load_no > 6 ORDER BY arr_row DESC) AS k FROM arrangements), b AS (SELECT * FROM a WHERE k = 1), f AS (SELECT * FROM b WHERE late AND arr_name IS NOT NULL AND arrangement_id IS NOT NULL) SELECT arrangement_id, arr_row, arr_name, load_no FROM f UNION ALL SELECT arrangement_id, arr_row, arr_name, load_no FROM b WHERE NOT late AND arrangement_id NOT IN (SELECT arrangement_id FROM f)",
    "stream_latest_per_key": _LATEST,
    "stream_toggle_parity": _TOGGLED,
    "extra_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "extra_cube": "SELECT event_type, CAST(weekday AS INTEGER) AS weekday, count(*) AS n FROM (SELECT event_type, isodow(ts) - 1 AS weekday FROM events) GROUP BY CUBE (event_type, weekday)",
    "extra_full_outer": "SELECT coalesce(c.k, s.k) AS nation, n_customers, n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1) s ON c.k = s.k",
    "extra_intersect": "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "extra_window": "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
SQL["template_export_all"] = _FIELDS + f""", h AS (SELECT DISTINCT template_code, code, label FROM fields)
SELECT template_code, 1 AS part, CAST(NULL AS BIGINT) AS arr_row, string_agg({_CSV.format(c="code")}, ',' ORDER BY code) AS line FROM h GROUP BY template_code UNION ALL SELECT template_code, 2, NULL, string_agg({_CSV.format(c="label")}, ',' ORDER BY code) FROM h GROUP BY template_code UNION ALL SELECT template_code, 3, arr_row, string_agg({_CSV.format(c="value")}, ',' ORDER BY code) FROM fields GROUP BY template_code, arr_row"""
SQL["csv_document_all"] = f"WITH {_COLS} SELECT template_code, string_agg({_CSV.format(c='code')} || ',' || {_CSV.format(c='label')} || ',' || {_CSV.format(c='mandatory_raw')}, chr(13) || chr(10) ORDER BY code) AS csv FROM c GROUP BY template_code"
_ENTRIES = "(SELECT string_agg(e.key || '=' || coalesce(e.value, '~'), '|' ORDER BY e.key) FROM (SELECT unnest(map_entries({c})) AS e))"
_ENTRY_TEXT = "CASE WHEN {c} IS NOT NULL THEN coalesce(" + _ENTRIES + ", '') END"
SQL |= {
    "state_export": f"""SELECT arr_row, arrangement_id AS id, arr_name AS name, {_ENTRY_TEXT.format(c='answers')} AS answers, {_ENTRY_TEXT.format(c='manual')} AS manual,
  CASE WHEN chain IS NOT NULL THEN array_to_string(list_transform(chain, lambda c: CASE WHEN c IS NULL THEN '>' ELSE coalesce(c.provider_code, '') || '>' || coalesce(c.recipient_code, '') END), '|') END AS chain, created_at AS "createdAt", updated_at AS "updatedAt" FROM arrangements""",
    "import_result": """SELECT arr_row, CASE WHEN arr_row % 11 = 0 OR arr_row % 13 = 0 OR arr_row % 17 = 0 THEN -1 WHEN arr_row % 19 = 0 THEN 1 WHEN arrangement_id IS NOT NULL AND arr_name IS NOT NULL AND answers IS NOT NULL THEN 1 ELSE 0 END AS n_imported,
  CASE WHEN arr_row % 11 = 0 OR arr_row % 13 = 0 OR arr_row % 17 = 0 THEN '' WHEN arr_row % 19 = 0 THEN 'a' WHEN arrangement_id IS NOT NULL AND arr_name IS NOT NULL AND answers IS NOT NULL THEN arrangement_id ELSE '' END AS ids FROM arrangements""",
    "template_heads": f"""WITH {_COLS}, a AS (SELECT template_code, code, label FROM c UNION ALL SELECT 'B_98.01', 'B_98.01.0010', 'a;b')
SELECT template_code, 1 AS part, CAST(NULL AS BIGINT) AS arr_row, string_agg({_CSV.format(c='code')}, ',' ORDER BY code) AS line FROM a GROUP BY template_code UNION ALL SELECT template_code, 2, NULL, string_agg({_CSV.format(c='label')}, ',' ORDER BY code) FROM a GROUP BY template_code""",
    "schema_derivation": f"WITH {_COLS} SELECT substring(code, 1, 7) AS template_code, code, trim(label, ' ') AS label, trim(coalesce(soort, ''), ' ') AS soort, trim(coalesce(instruction, ''), ' ') AS instruction, trim(coalesce(mandatory_raw, ''), ' ') AS mandatory_raw, trim(coalesce(mandatory_raw, ''), ' ') = 'Verplicht' AS mandatory FROM c WHERE label IS NOT NULL AND template_code <> 'B_25.01'",
    "schema_templates": f"WITH {_COLS} SELECT DISTINCT template_code, 'Model ' || template_code AS name, 'Tekst' AS description FROM c WHERE label IS NOT NULL AND template_code <> 'B_25.01'",
    "closed_list_matrix": "SELECT column_code, trim(official_text, ' ') AS official_text FROM closed_lists",
    "service_codes": "SELECT 'S' || lpad(CAST(item_no AS VARCHAR), 2, '0') AS code, 'Dienst ' || item_no AS label, trim(column_label, ' ') AS description FROM closed_lists",
    "fill_sources": f"""WITH {_COLS} SELECT code, label, CASE WHEN code IN (SELECT column_code FROM closed_lists) THEN 'assessment:q-' || code WHEN code IN ('B_21.01.0020', 'B_21.01.0050', 'B_22.01.0090') THEN 'auto' WHEN code IN ('B_22.01.0090', 'B_22.01.0120', 'B_21.01.0020') THEN 'supplier' ELSE 'manual' END AS fill_source,
  code IN ('B_22.01.0090', 'B_22.01.0120', 'B_21.01.0020') AND (code IN (SELECT column_code FROM closed_lists) OR code NOT IN ('B_21.01.0020', 'B_21.01.0050', 'B_22.01.0090')) AS ask_supplier FROM c""",
    "remapped_lists": "SELECT CASE WHEN column_code = 'B_21.01.0020' THEN 'X_21.01.0020' ELSE column_code END AS column_code, item_no, official_text FROM closed_lists",
    "rule_derived_flags": _V + "SELECT arr_row, array_to_string(list_sort(list_filter([CASE WHEN digitaal THEN 'digitaal' END, CASE WHEN groep THEN 'groep' END, CASE WHEN keten THEN 'keten' END, CASE WHEN kritiek THEN 'kritiek' END, CASE WHEN digitaal AND kritiek THEN 'zwaar' END, CASE WHEN NOT keten THEN 'licht' END], lambda x: x IS NOT NULL)), ',') AS flags FROM g",
    "rule_column_questions": _V + "SELECT arr_row, question_id, CASE question_id WHEN 's1.1' THEN 'B_21.01.0010' WHEN 's4.2' THEN 'B_22.01.0020' ELSE 'B_23.01.0030' END AS column_code, answer FROM v WHERE question_id IN ('s1.1', 's4.2', 's12.1')",
    "stream_windowed_counts": SQL["extra_window"],
}
