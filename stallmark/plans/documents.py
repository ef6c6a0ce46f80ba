"""Queries over stored JSON documents and model answers, made of the rows of `part` and `lineitem`, with the SQL of the same rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmark.analyzers.base import Listing
from stallmark.analyzers.gpu import GpuAnalyzer
from stallmark.functions.text import made_once
from stallmark.operators import contracts
from stallmark.plans import views

#: Documents in the expressions of both engines: {0} stands for the row's own mixed number.
_MIXED = "(p_partkey * 7919 + p_size * 104729) % 1000003"
_ANSWER = """concat('{"score":', CASE WHEN x % 17 = 0 THEN '"high"' WHEN x % 7 = 0 THEN concat(p_size, '.5') ELSE cast(p_size * 3 - 20 AS STRING) END, ',"verdict":"', CASE x % 6 WHEN 0 THEN 'bad' WHEN 1 THEN 'weak' WHEN 2 THEN 'fair' WHEN 3 THEN 'good' WHEN 4 THEN 'excellent_deal' ELSE 'great' END,
 '","advantages":[', CASE WHEN x % 19 = 0 THEN '" "' WHEN x % 13 = 0 THEN '1,"a"' WHEN x % 11 = 0 THEN '"a","b","c","d","e","f","g","h","i","j","k"' ELSE concat('" ', p_type, ' "') END, '],"risks":', CASE WHEN x % 29 = 0 THEN 'null' ELSE '[]' END,
 CASE WHEN x % 23 = 0 THEN '' ELSE concat(',"reason":"', CASE WHEN x % 31 = 0 THEN '  ' ELSE p_name END, '"') END, CASE WHEN x % 5 = 0 THEN ',"note":1,"also":[2]' ELSE '' END, CASE WHEN x % 101 = 0 THEN '' ELSE '}' END)"""
_CARD = """concat('{"gpuVendor":', CASE x % 5 WHEN 0 THEN '"NVIDIA"' WHEN 1 THEN '"AMD"' WHEN 2 THEN '"Intel"' WHEN 3 THEN '"Matrox"' ELSE 'null' END, ',"model":"', p_name, '","normalizedModel":null,"boardBrand":"', p_brand, '","vramGb":', CASE WHEN x % 11 = 0 THEN '"8"' ELSE cast(p_size % 9 - 1 AS STRING) END,
 ',"condition":"', CASE WHEN x % 4 = 0 THEN 'mint' ELSE 'used' END, '","usageTime":null,"warranty":null,"hasBox":', CASE x % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'null' ELSE 'false' END, ',"miningMentioned":false,"sellerClaimsNoMining":', CASE WHEN x % 37 = 0 THEN '0' ELSE 'true' END, ',"defects":["', p_type, '"]',
 CASE WHEN x % 7 = 0 THEN '' ELSE ',"repairsMentioned":false' END, '}')"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.dealt(views.table(spark, sf_dir, "part"), "p_partkey").withColumn("x", F.expr(_MIXED))
    return rows.select("p_partkey", F.lit("deal_analysis").alias("contract"), F.expr(_ANSWER).alias("doc")).unionByName(rows.select("p_partkey", F.lit("gpu").alias("contract"), F.expr(_CARD).alias("doc")))


_DOCUMENTS_SQL = f"""rows AS (SELECT *, {_MIXED} AS x FROM part), docs AS (SELECT p_partkey, 'deal_analysis' AS contract, {_ANSWER} AS doc FROM rows UNION ALL SELECT p_partkey, 'gpu', {_CARD} FROM rows)"""


def _list(items: list[str]) -> str:
    return "[" + ", ".join(items) + "]" if items else "[]::VARCHAR[]"


def _rule_sql(r: contracts.Rule) -> str:
    """The reasons of one key as DuckDB's JSON functions find them."""
    kind, text = f"json_type(j, '$.{r.name}')", f"json_extract_string(j, '$.{r.name}')"
    text = f"trim({text})" if r.trimmed else text
    size = f"length({text})" if r.kind == "string" else f"{text}::DOUBLE"
    items = f"list_transform(json_extract(j, '$.{r.name}[*]'), lambda y: trim(json_extract_string(y, '$')))"
    fits = {"string": f"{kind} = 'VARCHAR'", "number": f"{kind} IN ('BIGINT', 'UBIGINT', 'DOUBLE')", "boolean": f"{kind} = 'BOOLEAN'", "strings": f"({kind} = 'ARRAY' AND len(list_filter(json_extract(j, '$.{r.name}[*]'), lambda y: json_type(y) <> 'VARCHAR')) = 0)"}[r.kind]
    say = lambda bad, what: f"CASE WHEN {bad} THEN '{r.name}: {what}' END"
    checks = [say(f"{text} NOT IN ({', '.join(map(repr, r.among))})", "not one of " + ", ".join(r.among))] if r.among else []
    if r.kind == "strings" and r.items is not None:
        checks += [say(f"len(list_filter({items}, lambda y: length(y) < {r.least})) > 0", f"holds less than {r.least:g}"), say(f"len(list_filter({items}, lambda y: length(y) > {r.most})) > 0", f"holds more than {r.most:g}"), say(f"len({items}) > {r.items}", f"more than {r.items} items")]
    elif r.kind != "strings":
        checks += [say(f"{size} < {r.least}", f"less than {r.least:g}")] if r.least is not None else []
        checks += [say(f"{size} <= {r.above}", f"not above {r.above:g}")] if r.above is not None else []
        checks += [say(f"{size} > {r.most}", f"more than {r.most:g}")] if r.most is not None else []
    null = "[]::VARCHAR[]" if r.nullable else f"['{r.name}: null']"
    found = f"list_filter({_list(checks)}, lambda y: y IS NOT NULL)" if checks else "[]::VARCHAR[]"
    return f"CASE WHEN {kind} IS NULL THEN ['{r.name}: missing'] WHEN {kind} = 'NULL' THEN {null} WHEN NOT {fits} THEN ['{r.name}: not {r.kind}'] ELSE {found} END"


def _contract_sql(c: contracts.Contract) -> str:
    keys = _list([repr(r.name) for r in c.rules])
    return f"""SELECT p_partkey, contract, CASE WHEN j IS NULL THEN 'not an object' ELSE array_to_string(flatten({_list([_rule_sql(r) for r in c.rules])}), '; ') END AS reasons,
 array_to_string(list_sort(list_filter(json_keys(j), lambda y: NOT list_contains({keys}, y))), ',') AS unknown FROM parsed WHERE contract = '{c.name}'"""


def document_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers and stored cards against their contracts: the reasons of the rejected, and the keys that a kept one has
    beyond its contract."""
    out = None
    for c in (contracts.DEAL_ANALYSIS, contracts.GPU):
        rows = contracts.checked(_documents(spark, sf_dir).where(F.col("contract") == c.name), "doc", c)
        rows = rows.select("p_partkey", "contract", F.array_join("reasons", "; ").alias("reasons"), F.when(F.size("reasons") == 0, F.array_join("unknown_keys", ",")).alias("unknown_keys"))
        out = rows if out is None else out.unionByName(rows)
    return out


DOCUMENT_REASONS = f"""WITH {_DOCUMENTS_SQL}, parsed AS (SELECT p_partkey, contract, CASE WHEN json_valid(doc) THEN doc::JSON END AS j FROM docs),
 r AS ({_contract_sql(contracts.DEAL_ANALYSIS)} UNION ALL {_contract_sql(contracts.GPU)}) SELECT p_partkey, contract, reasons, CASE WHEN reasons = '' THEN unknown END AS unknown_keys FROM r"""


def kept_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers that keep the contract, as values: texts without the space around them."""
    good, _ = contracts.held_to(_documents(spark, sf_dir).where("contract = 'deal_analysis'"), "doc", contracts.DEAL_ANALYSIS)
    return good.select("p_partkey", "value.score", "value.verdict", F.array_join("value.advantages", "|").alias("advantages"), "value.reason")


KEPT_ANSWERS = f"""WITH {_DOCUMENTS_SQL}, parsed AS (SELECT p_partkey, contract, CASE WHEN json_valid(doc) THEN doc::JSON END AS j FROM docs), r AS ({_contract_sql(contracts.DEAL_ANALYSIS)})
 SELECT p_partkey, json_extract_string(j, '$.score')::DOUBLE AS score, json_extract_string(j, '$.verdict') AS verdict, array_to_string(list_transform(json_extract(j, '$.advantages[*]'), lambda y: trim(json_extract_string(y, '$'))), '|') AS advantages, trim(json_extract_string(j, '$.reason')) AS reason
 FROM r JOIN parsed USING (p_partkey, contract) WHERE reasons = ''"""


def _ad() -> Column:
    """An advertisement of a card: its model, and as many gigabytes as the mixed number says, none at all or 0 among them."""
    memory = F.when(F.expr("x % 6 = 0"), "").otherwise(F.concat(F.lit(" "), F.expr("cast(x % 5 * 4 as string)"), F.lit("gb")))
    return F.concat(F.lit("Placa RTX 30"), F.expr("cast(5 + x % 4 as string)"), F.lit("0"), memory, F.lit(" usada"))


def extraction_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the card analyzer reads in advertisements, and why a store refuses some of it."""
    rows = views.dealt(views.table(spark, sf_dir, "part"), "p_partkey").withColumn("x", F.expr(_MIXED)).withColumn("title", _ad())
    listing = Listing(F.col("title"), F.lit(None).cast("string"), F.create_map().cast("map<string,string>"))
    good, bad = contracts.gate_extractions(rows.withColumn("d", made_once(GpuAnalyzer().extract(listing))), "d", contracts.GPU)
    columns = ["p_partkey", "d.normalized_model", "d.vram_gb"]
    return good.select(*columns, F.lit("").alias("reasons")).unionByName(bad.select(*columns, F.array_join("reasons", "; ").alias("reasons")))


EXTRACTION_REJECTS = f"""WITH rows AS (SELECT *, {_MIXED} AS x FROM part) SELECT p_partkey, concat('NVIDIA GeForce RTX 30', 5 + x % 4, '0') AS normalized_model, CASE WHEN x % 6 <> 0 THEN (x % 5 * 4)::INT END AS vram_gb,
 CASE WHEN x % 6 <> 0 AND x % 5 = 0 THEN 'vramGb: not above 0' ELSE '' END AS reasons FROM rows"""
