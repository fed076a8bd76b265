"""Readers: every table has an explicit schema, absent fields get their default."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions import lexicons as L, text as T

LABELED = "id string, text string, expert_score double, max_score double, domain string, rubric string"
FRAMEWORK = ("id string, name string, pass_mark double, criteria array<struct<id:string,title:string,description:string,max_score:double,weight:double,"
             "rubric:array<struct<level:string,score_range:string,descriptor:string>>>>")
NODE_SCORES = ("id string, node_scores array<struct<node_iri:string,score:double,justification:string,source_text:string,source_span:array<int>>>, turtle string")
BATCH_SCORES = "id string, score double"
EXTRACTIONS = ("id string, claims array<struct<text:string,specificity:double,verifiable:boolean>>,"
               " evidence array<struct<source:string,type:string,text:string,quantified:boolean>>")
HISTORY = ("id string, document_title string, doc_type string, intent string, framework_name string, overall_score double, max_possible double,"
           " percentage double, passed boolean, criterion_scores array<struct<criterion_id:string,criterion_title:string,consensus_score:double,"
           "max_score:double,percentage:double>>, agent_count bigint, debate_rounds bigint, evaluated_at string, weaknesses array<string>,"
           " document_type string, timestamp string")
ATTACK_CLASSES = "class string, parent string, severity string, lang string, patterns string"
ANCHORS = "id string, score double, evidence_profile struct<word_count:double,num_counter_arguments:double,num_complex_sentences:double,num_cohesion_devices:double,num_vocabulary_markers:double,num_topic_sentences:double,num_personal_voice:double,num_rhetorical_devices:double,has_thesis:boolean,total_evidence:double,avg_quality:double>"


def _json(spark: SparkSession, path, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_labeled(spark: SparkSession, path) -> DataFrame:
    """JSON arrays of labelled samples; extra keys are ignored."""
    return _json(spark, path, LABELED).fillna("", subset=["domain", "rubric"])


def read_text_corpus(spark: SparkSession, path) -> DataFrame:
    """One document per md or txt file below a folder, in any letter case: (path,
    doc_id, title, doc_type, text). PDF and DOCX need a decoder and are left out."""
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(decoded.alias("path"), F.col("value").alias("text"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return raw.where(ext.isin("md", "txt")).select(
        "path", F.xxhash64("path").alias("doc_id"), F.regexp_replace(name, r"\.[^.]+$", "").alias("title"), ext.alias("doc_type"), "text")


LOT = r"(?i)(?:^|[\s_\-/\\])lot[\s_\-]?(\d+)(?:[\s_\-/\\.]|$)"
LOT_START = r"(?i)^lot[\s_\-]?(\d+)"


def classify_lots(files: DataFrame, root: str = "") -> DataFrame:
    """Adds scope ('lot' or 'shared'), lot_no, lot_key, lot_name and shared_marker
    from the path below ``root``; the deepest component naming a lot wins."""
    rel = F.regexp_replace("path", "^" + root.rstrip("/").replace(".", r"\.") + "/?", "") if root else F.col("path")
    parts = F.reverse(F.split(rel, "/"))
    number = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, LOT, 1), F.lit("")), F.nullif(F.regexp_extract(c, LOT_START, 1), F.lit("")))
    found = F.get(F.array_compact(F.transform(parts, number)), F.lit(0))
    lot = F.when(found.isNotNull(), F.coalesce(found.try_cast("int"), F.lit(0)))  # a number too large for a lot is lot 0
    d = files.withColumn("lot_no", lot)
    return d.withColumns({
        "scope": F.when(F.col("lot_no").isNull(), "shared").otherwise("lot"),
        "lot_key": F.concat(F.lit("lot_"), F.col("lot_no").cast("string")), "lot_name": F.concat(F.lit("Lot "), F.col("lot_no").cast("string")),
        "shared_marker": T.contains_any(F.lower(rel), L.SHARED_PATTERNS)})


def lot_summary(files: DataFrame) -> DataFrame:
    return files.where("scope = 'lot'").groupBy("lot_no", "lot_key", "lot_name").agg(F.count("*").alias("documents")).orderBy("lot_no")


def read_framework(spark: SparkSession, path) -> DataFrame:
    """Rubric files (JSON): one row per criterion, with total weight and rubric."""
    f = _json(spark, path, FRAMEWORK)
    total = F.aggregate("criteria", F.lit(0.0), lambda a, c: a + c["weight"])
    fid = F.coalesce("id", F.lower(F.regexp_replace("name", "[^A-Za-z0-9]+", "_")))
    rows = f.select(fid.alias("framework_id"), F.col("name").alias("framework_name"), "pass_mark", total.alias("total_weight"),
                    F.posexplode("criteria").alias("criterion_no", "c"))
    cid = F.coalesce("c.id", F.lower(F.regexp_replace("c.title", "[^A-Za-z0-9]+", "_")))
    return rows.select("framework_id", "framework_name", "pass_mark", "total_weight", "criterion_no", cid.alias("criterion_id"),
                       "c.title", "c.description", "c.max_score", "c.weight", F.col("c.rubric").alias("rubric_levels"))


def read_graph_scores(spark: SparkSession, path) -> DataFrame:
    """Scored nodes as rows (doc_id, pos, node_iri, score, justification, source_text, span)."""
    g = _json(spark, path, NODE_SCORES).select(F.col("id").alias("doc_id"), F.posexplode("node_scores").alias("pos", "n"))
    span = F.when(F.col("n.source_span").isNotNull(), F.struct(F.col("n.source_span")[0].alias("start"), F.col("n.source_span")[1].alias("end")))
    return g.select("doc_id", "pos", "n.node_iri", "n.score", F.coalesce("n.justification", F.lit("")).alias("justification"), "n.source_text", span.alias("span"))


def read_score_batches(spark: SparkSession, folder: str) -> DataFrame:
    return _json(spark, f"{folder}/batch_*_scores.json", BATCH_SCORES)


def read_extractions(spark: SparkSession, path) -> DataFrame:
    """External claims and evidence as rows (doc_id, section_no, role, no, text, ...)."""
    x = _json(spark, path, EXTRACTIONS).withColumnRenamed("id", "doc_id")
    none_s, none_b = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    c = x.select("doc_id", F.posexplode("claims").alias("no", "x")).select(
        "doc_id", F.lit(1).alias("section_no"), F.lit("claim").alias("role"), "no", "x.text", "x.specificity", "x.verifiable", none_s.alias("source"),
        none_s.alias("evidence_type"), none_b.alias("quantified"))
    e = x.select("doc_id", F.posexplode("evidence").alias("no", "x")).select(
        "doc_id", F.lit(1).alias("section_no"), F.lit("evidence").alias("role"), "no", "x.text", F.lit(None).cast("double").alias("specificity"),
        none_b.alias("verifiable"), "x.source", F.col("x.type").alias("evidence_type"), "x.quantified")
    return c.unionByName(e)


def read_history(spark: SparkSession, folder: str, framework: str | None = None) -> DataFrame:
    """History records, one in each line or one printed over a whole file; broken ones
    are dropped, times parsed. Order by evaluated_at where order matters."""
    own = spark.read.schema(HISTORY).option("mode", "DROPMALFORMED")
    file = F.col("_metadata.file_path").alias("_file")
    lines = own.json(folder).select("*", file)
    whole = own.option("multiLine", True).json(folder).select("*", file)
    h = lines.unionByName(whole.join(lines.select("_file").distinct(), "_file", "left_anti")).drop("_file")
    h = h.fillna("", subset=["document_type", "timestamp"]).withColumn("weaknesses", F.coalesce("weaknesses", F.array().cast("array<string>")))
    h = h.withColumn("evaluated_at", F.try_to_timestamp("evaluated_at"))
    return h if framework is None else h.where(F.col("framework_name") == framework)


def read_attack_lexicon(spark: SparkSession, path) -> DataFrame:
    return _json(spark, path, ATTACK_CLASSES)


_STRING = r'"(?:\\.|[^"\\])*"'
_STATEMENT = rf'(?s)(?:{_STRING}|<[^>]*>|[^".<]|\.(?!\s|\z))+'
_PREDICATE = rf'(?s)(?:{_STRING}|<[^>]*>|[^";<])+'


def read_attack_ontology(spark: SparkSession, path) -> DataFrame:
    """The class blocks of Turtle files as read_attack_lexicon has them: (class, parent,
    severity, lang, patterns), one row for each class, parent and language of patterns.

    Read are statements ``subject a owl:Class ; rdfs:subClassOf parent ; x:severity "..." ;
    x:patterns "a;b" ; x:patterns_de "c" .`` with names as IRIs or prefixed, comments,
    escaped quotes; other predicates are passed over. The language of ``patterns`` is en.
    A file is one row, as a document is; a class may be spread over statements."""
    local = lambda c: F.regexp_extract(c, r"([^/#:<>]*)>?\s*$", 1)
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", rf"(?s)({_STRING}|<[^>]*>)|#[^\n]*", "$1").alias("t"))
    said = raw.select(F.explode(F.regexp_extract_all("t", F.lit(_STATEMENT), F.lit(0))).alias("s"))
    parts = said.select(F.regexp_extract_all(T.ws_trim(F.col("s")), F.lit(_PREDICATE), F.lit(0)).alias("p")).where(F.size("p") > 0)
    subject = local(F.regexp_extract(T.ws_trim(F.get("p", F.lit(0))), r"^(\S+)", 1))
    first = F.array(T.ws_trim(F.regexp_replace(T.ws_trim(F.get("p", F.lit(0))), r"^\S+\s*", "")))
    pairs = parts.select(subject.alias("class"), F.explode(F.concat(first, F.transform(F.slice("p", 2, F.size("p")), lambda x: T.ws_trim(x)))).alias("x"))
    named = pairs.select("class", local(F.regexp_extract("x", r"^(\S+)", 1)).alias("name"), T.ws_trim(F.regexp_replace("x", r"^\S+\s*", "")).alias("object"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_extract("object", rf"(?s)^({_STRING})", 1), r'^"|"$', ""), r'\\(["\\])', "$1")
    facts = named.select("class", "name", local("object").alias("target"), text.alias("text"))
    parents = facts.where("name = 'subClassOf'").select("class", F.col("target").alias("parent"))
    severity = facts.where("name = 'severity'").groupBy("class").agg(F.min("text").alias("severity"))
    lists = facts.where(F.col("name").rlike("^patterns(_|$)")).select(
        "class", F.coalesce(F.nullif(F.regexp_extract("name", "^patterns_(.+)$", 1), F.lit("")), F.lit("en")).alias("lang"), F.col("text").alias("patterns"))
    return parents.join(severity, "class", "left").join(lists, "class", "left").select("class", "parent", "severity", F.coalesce("lang", F.lit("en")).alias("lang"), F.coalesce("patterns", F.lit("")).alias("patterns"))


def read_anchors(spark: SparkSession, path) -> DataFrame:
    """Anchors (doc_id, score, profile) ready for calibration.nearest_anchor."""
    p = lambda n: F.col(f"evidence_profile.{n}").cast("double")
    profile = F.array(
        F.least(p("word_count") / 500.0, F.lit(2.0)), p("num_counter_arguments"), p("num_complex_sentences") / 5.0, p("num_cohesion_devices"),
        p("num_vocabulary_markers"), p("num_topic_sentences"), p("num_personal_voice"), p("num_rhetorical_devices") / 5.0, p("has_thesis"), p("avg_quality"))
    return _json(spark, path, ANCHORS).select(F.col("id").alias("doc_id"), "score", profile.alias("profile"))
