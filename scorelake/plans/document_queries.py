"""Queries over documents, pages, generated replies and the case registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.text import split_list
from scorelake.operators import assertions, catalog, crawl, display, documents, replies, summary, traces
from scorelake.plans import bindings as b
from scorelake.plans.case_queries import ASSERTIONS_SQL
from scorelake.plans.registry import query, rounded, with_
from scorelake.session import new_table_path
from scorelake.sources import cases, history, results
from scorelake.sources.documents import check_source, read_documents, require_documents, scan_objects

# --- pages ------------------------------------------------------------------------------------------------------

_BLANKS = "chr(32) || chr(10) || chr(9) || chr(13) || chr(160) || chr(8195) || chr(12288)"
_HTML_SQL = f"""
plain as (
  select page_id, url, trim(regexp_replace(regexp_replace(
    replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'gsi'), '<[^>]+>', ' ', 'gs'),
      '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '),
    '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), {_BLANKS}) as content
  from pages)"""


@query("html_to_text", with_(_HTML_SQL, "select page_id, content from plain"))
def html_to_text(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", documents.html_to_text(F.col("html")).alias("content"))


@query("bench_html", with_(_HTML_SQL, "select page_id % 10 as bucket, cast(sum(length(content)) as bigint) chars from plain group by 1"))
def bench_html(spark, sf):
    return html_to_text(spark, sf).groupBy((F.col("page_id") % 10).alias("bucket")).agg(
        F.sum(F.length("content")).alias("chars")
    )


_NAME_SQL = """
last_segment as (
  select page_id, url, case when list_last(string_split(rtrim(url, '/'), '/')) = '' then 'index'
                            else list_last(string_split(rtrim(url, '/'), '/')) end seg
  from pages),
names as (
  select page_id, case when contains(split_part(seg, '?', 1), '.') then seg
                       else split_part(seg, '?', 1) || '.txt' end filename from last_segment)"""


@query("filenames", with_(_NAME_SQL, "select page_id, filename from names"))
def filenames(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", documents.page_filename(F.col("url")).alias("filename"))


@query(
    "page_documents",
    with_(
        _HTML_SQL + ",\n" + _NAME_SQL.lstrip(),
        "select url as source, filename, content from plain join names using (page_id)",
    ),
)
def page_documents(spark, sf):
    return check_source(documents.page_documents(b.table(spark, sf, "pages")))


@query(
    "page_links",
    """select page_id, cast(row_number() over (partition by page_id order by first) - 1 as int) pos, link from (
         select page_id, link, min(i) first from (
           select page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || h link, i from (
             select page_id, url, unnest(hs) h, generate_subscripts(hs, 1) i from (
               select page_id, url, regexp_extract_all(html, '(?i)href=["'']([^"''#\\s]+)', 1) hs from pages)))
         group by page_id, link)""",
)
def page_links(spark, sf):
    return documents.link_rows(b.table(spark, sf, "pages"), ("page_id",))


@query(
    "crawl",
    """with recursive shop as (select o_orderkey k from orders where o_orderstatus <> 'P'),
       reach as (
         select r_regionkey + 1 seed, r_regionkey + 1 k, 0 as depth from region join shop on k = r_regionkey + 1
         union all
         select seed, shop.k, depth + 1 from reach join (select unnest([1, 2, 3, 4]) i) on true
         join shop on shop.k = 4 * reach.k + i)
       select 'http://shop.test/s/' || seed seed, 'http://shop.test/s/' || k url, cast(depth as int) as level,
              cast(pos as int) as position
       from (select *, row_number() over (partition by seed order by depth, k) - 1 pos from reach) where pos < 600""",
)
def crawl_shop(spark, sf):
    """Crawl a site with a page per order, from one seed per region.

    Order k links to the orders 4k + 1 to 4k + 4, to itself and out of the site; orders in status P have
    no page.
    """
    orders, region = b.table(spark, sf, "orders"), b.table(spark, sf, "region")
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    html = F.concat(
        F.lit('<html><a href="https://other.test/">out</a> <a href="/">home</a> <a href="'), text(k),
        F.lit('">self</a> <a href="./'), text(4 * k + 1), F.lit("\">1</a> <a HREF='../s/"), text(4 * k + 2),
        F.lit("#top'>2</a> <a href=\"/s/"), text(4 * k + 3), F.lit('">3</a> <a href="http://shop.test/s/'), text(4 * k + 4),
        F.lit('">4</a></html>'),
    )
    url = lambda c: F.concat(F.lit("http://shop.test/s/"), text(c))
    pages = orders.filter(F.col("o_orderstatus") != "P").select(url(k).alias("url"), html.alias("html"))
    return crawl.crawl(pages, region.select(url(F.col("r_regionkey") + 1).alias("url")), 600)


# --- chunks and quotas ------------------------------------------------------------------------------------------

_CHUNK_SQL = """
d as (select doc_id, text, length(text) n from documents),
cut as (
  select doc_id, 0 st, 0 e, 0 k from d where n > 2000
  union all
  select doc_id, e, case when e + 2000 < n and b > 0 then e + b else least(e + 2000, n) end, k + 1
  from (select cut.doc_id, cut.e, cut.k, d.n,
               2000 - instr(reverse(substr(d.text, cut.e + 1, 2000)), chr(10))
               + case when instr(reverse(substr(d.text, cut.e + 1, 2000)), chr(10)) = 0 then -2000 else 0 end b
        from cut join d using (doc_id) where cut.e < d.n) z),
pieces as (
  select doc_id, k, trim(substr(text, st + 1, e - st), chr(32) || chr(10) || chr(9) || chr(13)) piece
  from cut join d using (doc_id) where k > 0
  union all
  select doc_id, 0, text from d where n <= 2000),
chunked as (
  select doc_id, cast(count(*) over (partition by doc_id) as int) chunks,
         cast(row_number() over (partition by doc_id order by k) - 1 as int) chunk_no, piece
  from pieces where k = 0 or piece <> '')"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return documents.chunk_documents(b.table(spark, sf, "documents"), ("doc_id",), "text", 2000, "\n")


@query("chunks", with_(_CHUNK_SQL, "select doc_id, chunks, chunk_no, piece as text from chunked"))
def chunks(spark, sf):
    return _chunks(spark, sf)


@query(
    "quota_chunks",
    with_(
        _CHUNK_SQL,
        """select doc_id, chunk_no, cast(greatest(0, least(greatest(1, ceil(7 / chunks)),
           7 - chunk_no * greatest(1, ceil(7 / chunks)))) as int) quota from chunked""",
    ),
)
def quota_chunks(spark, sf):
    asked = documents.quota_at(F.col("chunk_no"), F.col("chunks"), F.lit(7))
    return _chunks(spark, sf).select("doc_id", "chunk_no", asked.alias("quota"))


@query(
    "quota_docs",
    """select doc_id, cast(greatest(0, least(share, 2500 - i * share)) as int) quota from (
         select doc_id, row_number() over (order by doc_id) - 1 i, greatest(1, ceil(2500 / count(*) over ())) share
         from documents)""",
)
def quota_docs(spark, sf):
    return documents.quota_documents(b.table(spark, sf, "documents").select("doc_id"), 2500, ["doc_id"])


@query(
    "quota_remaining",
    """select doc_id, lang, cast(greatest(0, least(greatest(1, ceil(500 / items)), 500 - made)) as int) quota from (
         select doc_id, lang, count(*) over (partition by lang) items,
                coalesce(sum(doc_id % 3) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0) made
         from documents)""",
)
def quota_remaining(spark, sf):
    """Quotas when documents gave fewer cases than asked, per language."""
    d = b.table(spark, sf, "documents").select("doc_id", "lang", (F.col("doc_id") % 3).alias("made"))
    return documents.remaining_quota(d, F.lit(500), ["doc_id"], "made", ["lang"]).select("doc_id", "lang", "quota")


# --- generated replies ------------------------------------------------------------------------------------------


def _quoted(text: Column) -> Column:
    packed = F.to_json(F.array(text))
    return F.substring(packed, F.lit(2), F.length(packed) - 2)


def _dealt(spark: SparkSession, sf: str) -> DataFrame:
    """Documents dealt out over all cores: a file's row group is one task's, and parsing replies built from it is costly."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return b.table(spark, sf, "documents").select("doc_id", "text", "lang", "source").repartition(tasks)


def _generated(spark: SparkSession, sf: str) -> DataFrame:
    """One reply per document: a list with a full, a bare and an incomplete element; some fenced, some broken."""
    n = F.col("doc_id")
    excerpt = _quoted(F.col("text"))
    items = F.concat(
        F.lit('[{"description": "d'), n.cast("string"), F.lit('", "input": {"query": '), excerpt,
        F.lit('}, "expected": {"ground_truth": "'), "lang", F.lit('"}, "tags": ["a", "'), "source",
        F.lit('"], "difficulty": "hard", "case_type": "negation", "source_excerpt": '), excerpt,
        F.lit('}, {"input": {"query": "q"}, "expected": {"ground_truth": "g"}}, {"input": {"query": "lost"}}, "noise"]'),
    )
    text = (
        F.when(n % 7 == 0, F.concat(F.lit("Sorry, no cases for "), n.cast("string")))
        .when(n % 2 == 0, F.concat(F.lit("```json\n"), items, F.lit("\n```")))
        .otherwise(items)
    )
    return _dealt(spark, sf).select("doc_id", text.alias("raw_text"))


@query(
    "parse_generated",
    """select doc_id, 0 item_no, 'd' || doc_id description, '{"query":' || to_json(text)::varchar || '}' as input,
       '{"ground_truth":"' || lang || '"}' expected, 'a|' || source tags, 'hard' difficulty, 'negation' case_type,
       text source_excerpt from documents where doc_id % 7 <> 0
       union all
       select doc_id, 1, '', '{"query":"q"}', '{"ground_truth":"g"}', '', 'medium', 'factual', '' from documents where doc_id % 7 <> 0""",
)
def parse_generated(spark, sf):
    return replies.parse_generated(_generated(spark, sf)).withColumn("tags", F.array_join("tags", "|"))


@query(
    "generated_errors",
    """select doc_id, 'Generator returned invalid JSON' || chr(10) || chr(10) || 'Raw output (first 500 chars):' || chr(10)
       || 'Sorry, no cases for ' || doc_id error from documents where doc_id % 7 = 0""",
)
def generated_errors(spark, sf):
    return replies.reply_errors(_generated(spark, sf))


_MIXED_REPLIES = (
    '[{"input": {"n": NaN}, "expected": {"b": 1.0, "a": 2}}, {"input": 1, "expected": "x"}]',
    '[{"input": {"n": 1}, "expected": 2}] see [1]',
    "[{'input': 1, 'expected': 2}]",
    '[{"input": "NaN, b", "expected": -Infinity, "tags": ["x"]}, 5, NaN]',
    '{"input": 1, "expected": 2}',
    '[{"input": 1, "expected": 2},]',
)


@query(
    "replies_once",
    """select doc_id, 'case' kind, c.input, c.expected from documents,
       (values (0, '{"n":NaN}', '{"b":1.0,"a":2}'), (0, '1', 'x'), (3, 'NaN, b', '-Infinity')) c(r, input, expected) where doc_id % 6 = r
       union all select doc_id, 'error', null, null from documents where doc_id % 6 in (1, 2, 5)""",
)
def replies_once(spark, sf):
    """A reply gives cases or an error, never both: what Python's JSON reader takes decides."""
    reply = F.element_at(F.array(*map(F.lit, _MIXED_REPLIES)), (F.col("doc_id") % 6 + 1).cast("int"))
    rows = b.table(spark, sf, "documents").select("doc_id", reply.alias("raw_text"))
    cases = replies.parse_generated(rows).select("doc_id", F.lit("case").alias("kind"), "input", "expected")
    none = F.lit(None).cast("string")
    return cases.unionByName(replies.reply_errors(rows).select("doc_id", F.lit("error").alias("kind"), none.alias("input"), none.alias("expected")))


@query(
    "staged_cases",
    """select doc_id, 'd' || doc_id description, 'hard' difficulty from documents where doc_id % 7 <> 0
       union all select doc_id, '', 'medium' from documents where doc_id % 7 <> 0""",
)
def staged_cases(spark, sf):
    """Write staged cases as JSON lines, read them back and make them importable."""
    path = new_table_path(spark, "staged")
    results.write_json_lines(replies.parse_generated(_generated(spark, sf)), path)
    staged = spark.read.schema(
        "doc_id long, description string, difficulty string, case_type string, source_excerpt string"
    ).json(path)
    return replies.importable(staged)


def _generated_agent(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    items = F.concat(
        F.lit('[{"task": "find '), "lang", F.lit('", "expected_answer": '),
        F.when(n % 2 == 0, "null").otherwise('"yes"'),
        F.lit(', "must_call": ["search"], "must_call_with": [{"tool": "search", "args": {"q": "'), "source",
        F.lit('"}}, {"args": {}}, {"tool": "open"}], "max_steps": '), (n % 9 + 1).cast("string"),
        F.lit('}, {"task": "bare"}, {"description": "no task"}]'),
    )
    text = F.when(n % 5 == 0, '{"task": "not a list"}').when(n % 11 == 0, "oops").otherwise(items)
    return b.table(spark, sf, "documents").select("doc_id", text.alias("raw_text"))


@query(
    "parse_generated_agent",
    """select doc_id, 0 item_no, 'find ' || lang task, case when doc_id % 2 <> 0 then 'yes' end answer, 'search' must_call,
       'search(q=' || source || ')|open()' must_call_with, cast(doc_id % 9 + 1 as int) max_steps
       from documents where doc_id % 5 <> 0 and doc_id % 11 <> 0
       union all
       select doc_id, 1, 'bare', null, '', '', 6 from documents where doc_id % 5 <> 0 and doc_id % 11 <> 0""",
)
def parse_generated_agent(spark, sf):
    """Agent replies parsed and turned into test cases."""
    made = traces.generated_to_case(replies.parse_generated_agent(_generated_agent(spark, sf)))
    e = F.col("expected")
    calls = F.transform(
        e["must_call_with"],
        lambda r: F.concat(
            r["tool"], F.lit("("),
            F.array_join(F.transform(F.map_entries(r["args"]), lambda a: F.concat(a["key"], F.lit("="), a["value"])), ","), F.lit(")"),
        ),
    )
    return made.select(
        "doc_id", "item_no", "task", e["answer"].alias("answer"), F.array_join(e["must_call"], "|").alias("must_call"),
        F.array_join(calls, "|").alias("must_call_with"), e["max_steps"].alias("max_steps"),
    )


# --- case registry ----------------------------------------------------------------------------------------------

_KINDS = ("qa", "classification", "instruction", "rag", "agent")


def _case_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One case line per document, its kind by id; some lines break a rule."""
    n = F.col("doc_id")
    head = _quoted(F.col("text"))
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (n % 5).cast("int") + 1)
    body = (
        F.when(kind == "qa", F.concat(F.lit('"input": {"query": '), head, F.lit('}, "expected": {"ground_truth": "x"}')))
        .when(kind == "classification", F.concat(F.lit('"input": {"text": '), head, F.lit('}, "expected": {"label": "x"}')))
        .when(kind == "instruction", F.concat(F.lit('"input": {"instruction": '), head, F.lit('}, "expected": {"rubric": "x"}')))
        .when(kind == "rag", F.concat(F.lit('"input": {"query": '), head, F.lit(', "retrieved_contexts": ["c"]}, "expected": {"ground_truth": "x"}')))
        .otherwise(F.concat(F.lit('"input": {"task": '), head, F.lit('}, "expected": {"must_call": ["t"], "max_steps": 4}')))
    )
    extra = (
        F.when(n % 13 == 1, '"id": 5, ')
        .when(n % 13 == 2, '"difficulty": "brutal", ')
        .when(n % 13 == 3, '"tags": "a", ')
        .when(n % 13 == 4, '"input": 3, "x": ')
        .otherwise(F.concat(F.lit('"id": "c'), n.cast("string"), F.lit('", "difficulty": "easy", "tags": ["t"], ')))
    )
    line = (
        F.when(n % 13 == 4, F.concat(F.lit('{"id": "c'), n.cast("string"), F.lit('", "expected": {}}')))
        .when(n % 13 == 5, F.concat(F.lit("{broken "), n.cast("string")))
        .otherwise(F.concat(F.lit("{"), extra, body, F.lit("}")))
    )
    return b.table(spark, sf, "documents").select("doc_id", "source", kind.alias("type"), line.alias("line"))


_LINES_SQL = f"""
lines as (
  select doc_id, source, {list(_KINDS)}[doc_id % 5 + 1] as kind, doc_id % 13 as fault,
         'case_' || {list(_KINDS)}[doc_id % 5 + 1] dataset from documents),
errs as (
  select *, case fault when 1 then ['id: not a string'] when 2 then ['difficulty: not one of easy, medium, hard']
    when 3 then ['tags: not a list of strings'] when 5 then ['not a JSON object']
    when 4 then case kind when 'qa' then ['input: field required', 'input.query: field required', 'expected.ground_truth: field required']
      when 'classification' then ['input: field required', 'input.text: field required', 'expected.label: field required']
      when 'instruction' then ['input: field required', 'input.instruction: field required', 'expected.rubric: field required']
      when 'rag' then ['input: field required', 'input.query: field required', 'expected.ground_truth: field required']
      else ['input: field required', 'input.task: field required'] end
    else [] end errors from lines)"""


@query("validate_cases", with_(_LINES_SQL, "select doc_id, kind as type, array_to_string(errors, '; ') errors, len(errors) = 0 valid from errs"))
def validate_cases(spark, sf):
    checked = cases.validate_cases(_case_lines(spark, sf))
    return checked.select("doc_id", "type", F.array_join("errors", "; ").alias("errors"), "valid")


@query(
    "case_scan",
    with_(
        _LINES_SQL,
        """select doc_id, case_id, kind as type, text, difficulty, must_call, max_steps from (
             select e.doc_id, 'c' || e.doc_id case_id, kind, d.text as text, 'easy' difficulty,
                    case when kind = 'agent' then 't' else '' end must_call, cast(case when kind = 'agent' then 4 end as int) max_steps, errors
             from errs e join documents d using (doc_id)) where len(errors) = 0""",
    ),
)
def case_scan(spark, sf):
    """Typed cases from the valid lines."""
    valid = cases.validate_cases(_case_lines(spark, sf)).filter("valid")
    parsed = cases.parse_cases(valid)
    text = F.coalesce("input.query", "input.text", "input.instruction", "input.task")
    return parsed.select(
        "doc_id", "case_id", "type", text.alias("text"), "difficulty", F.array_join("expected.must_call", "|").alias("must_call"),
        F.col("expected.max_steps").alias("max_steps"),
    )


@query(
    "numbered_lines",
    """select 'part=' || doc_id // 500 dataset, doc_id,
              cast(sum(1 + case when doc_id % 6 = 0 then 1 else 0 end + case when doc_id % 4 = 0 then 1 else 0 end) over w
                   - case when doc_id % 4 = 0 then 1 else 0 end as bigint) line_no,
              count(*) over w item_no
       from (select distinct doc_id from documents) window w as (partition by doc_id // 500 order by doc_id)""",
)
def numbered_lines(spark, sf):
    """Lines of files with blank lines between them, numbered with and without those, over the splits of each file."""
    path = new_table_path(spark, "lines")
    n = F.col("doc_id")
    own = F.array(F.struct(F.lit(1).alias("k"), F.concat(F.lit('{"doc": '), n.cast("string"), F.lit("}")).alias("value")))
    none = F.array().cast("array<struct<k:int,value:string>>")
    blank = lambda k, text, when: F.when(when, F.array(F.struct(F.lit(k).alias("k"), F.lit(text).alias("value")))).otherwise(none)
    rows = F.concat(blank(0, "  ", n % 6 == 0), own, blank(2, "", n % 4 == 0))
    lines = b.table(spark, sf, "documents").select("doc_id").distinct().select("doc_id", F.floor(n / 500).alias("part"), F.explode(rows).alias("r"))
    lines = lines.select("part", "doc_id", "r.*").repartition("part").sortWithinPartitions("part", "doc_id", "k")
    lines.select("part", "value").write.partitionBy("part").text(path)
    found = cases.read_numbered_lines(spark, path)
    return found.select("dataset", F.get_json_object("line", "$.doc").cast("long").alias("doc_id"), "line_no", "item_no")


def _named_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _case_lines(spark, sf).withColumn("dataset", F.concat(F.lit("case_"), "type"))


@query(
    "append_lenient",
    with_(
        _LINES_SQL,
        """select dataset, count(*) filter (len(errors) = 0) added, count(*) filter (len(errors) > 0) skipped,
           count(*) filter (len(errors) = 0) stored, cast(sum(doc_id) filter (len(errors) = 0) as bigint) ids from errs group by dataset""",
    ),
)
def append_lenient(spark, sf):
    path = new_table_path(spark, "cases")
    counts = cases.append_cases(_named_lines(spark, sf), path, on_error="skip")
    stored = spark.read.parquet(path)
    ids = stored.groupBy("dataset").agg(F.sum("doc_id").alias("ids"))
    return counts.join(summary.case_counts(stored).withColumnRenamed("case_count", "stored"), "dataset").join(ids, "dataset")


@query(
    "append_strict",
    with_(
        _LINES_SQL,
        """select dataset, count(*) filter (len(errors) > 0) bad, cast(sum(doc_id) filter (len(errors) > 0) as bigint) ids, 0::bigint stored from errs group by dataset
           having count(*) filter (len(errors) > 0) > 0""",
    ),
)
def append_strict(spark, sf):
    """A strict append of lines with errors adds nothing and reports them."""
    path = new_table_path(spark, "cases")
    good = _named_lines(spark, sf).filter(F.lit(False))
    cases.append_cases(good, path)
    try:
        cases.append_cases(_named_lines(spark, sf), path)
    except cases.InvalidCases as refused:
        bad = refused.errors.groupBy("dataset").agg(F.count("*").alias("bad"), F.sum("doc_id").alias("ids"))
        schema = "dataset string, doc_id long, source string, type string, line string"
        stored = spark.read.schema(schema).parquet(path).groupBy("dataset").agg(F.count("*").alias("_n"))
        return bad.join(stored, "dataset", "left").withColumn("stored", F.coalesce("_n", F.lit(0).cast("long"))).drop("_n")
    raise AssertionError("the strict append accepted invalid lines")


@query(
    "case_preview",
    """select dataset, doc_id from (select 'case_' || source dataset, doc_id, row_number() over (partition by source order by doc_id) r
       from documents) where r <= 10""",
)
def case_preview(spark, sf):
    d = b.table(spark, sf, "documents").select(F.concat(F.lit("case_"), "source").alias("dataset"), "doc_id")
    return display.preview(d, 10, order="doc_id")


def _metas(spark: SparkSession, sf: str) -> DataFrame:
    """A metadata document per document source; some are broken."""
    d = b.table(spark, sf, "documents").groupBy("source").agg(F.min("lang").alias("lang"), F.min("doc_id").alias("n"))
    good = F.concat(
        F.lit('{"name": "'), "source", F.lit('", "type": "qa", "tags": ["'), "lang",
        F.lit('"], "description": "about '), "lang", F.lit('", "updated_at": "2024-01-01", "thresholds": {"pass_rate": 0.5}}'),
    )
    meta = F.when(F.col("n") % 10 == 3, "{broken").when(F.col("n") % 10 == 4, '{"type": "qa"}').otherwise(good)
    return d.select("n", meta.alias("meta"))


_CATALOG_SQL = """
named as (select source as name, min(lang) lang, min(doc_id) n from documents group by source),
catalog as (select * from named where n % 10 not in (3, 4))"""


@query(
    "catalog_counts",
    with_(
        _CATALOG_SQL,
        """select name, 'qa' as type, lang tags, 'about ' || lang description, 0.5::double pass_rate, c.n case_count, b.rate baseline_pass_rate
           from catalog left join (select source, count(*) n from documents group by source) c on c.source = name
           left join (select source, """ + rounded("avg(quality)", 4) + """ rate from labels join documents using (doc_id) group by source) b on b.source = name""",
    ),
)
def catalog_counts(spark, sf):
    """The catalog with case counts and baseline rates; unreadable metadata is left out."""
    d = b.table(spark, sf, "documents").withColumnRenamed("source", "dataset")
    counts = summary.case_counts(d)
    base = b.table(spark, sf, "labels").join(d, "doc_id").groupBy("dataset").agg(
        F.avg("quality").alias("pass_rate"), F.count_if(F.col("quality") == 1).alias("passed"), F.count("*").alias("total")
    )
    listed = cases.parse_catalog(_metas(spark, sf))
    return catalog.with_baseline(catalog.with_counts(listed, counts), base).select(
        "name", "type", F.array_join("tags", "|").alias("tags"), "description", F.col("thresholds.pass_rate").alias("pass_rate"),
        "case_count", "baseline_pass_rate",
    )


@query(
    "metadata_update",
    with_(
        _CATALOG_SQL,
        """select name, case when n % 2 = 0 then 'new ' || name else 'about ' || lang end description,
           case when n % 3 = 0 then 'x|y' else lang end tags,
           case when n % 2 = 0 or n % 3 = 0 then '2024-06-30' else '2024-01-01' end updated_at from catalog""",
    ),
)
def metadata_update(spark, sf):
    """Update descriptions of some datasets and tags of others."""
    listed = cases.parse_catalog(_metas(spark, sf))
    n = F.col("n")
    updates = listed.select(
        "name",
        F.when(n % 2 == 0, F.concat(F.lit("new "), "name")).alias("description"),
        F.when(n % 3 == 0, split_list(F.lit(" x, ,y "))).alias("tags"),
    )
    return catalog.update_metadata(listed, updates, "2024-06-30").select(
        "name", "description", F.array_join("tags", "|").alias("tags"), "updated_at"
    )


@query(
    "comma_lists",
    """select doc_id, array_to_string(list_filter(list_transform(string_split(text, ','),
       lambda t: trim(t, chr(32) || chr(10) || chr(9) || chr(13))), lambda t: t <> ''), '|') items from documents""",
)
def comma_lists(spark, sf):
    return b.table(spark, sf, "documents").select(
        "doc_id", F.array_join(split_list("text"), "|").alias("items")
    )


def _versioned(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "documents").select(F.col("lang").alias("dataset"), "doc_id", "text")


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return _versioned(spark, sf).join(b.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


_VERSIONS_SQL = """select lang dataset, version, case when version = 'v1.2.0' then n1 else n2 end case_count,
  case when version = 'v1.2.0' then 'all' else 'labelled' end description, 'qa' as type
  from (select lang, count(*) n1, count(*) filter (doc_id in (select doc_id from labels)) n2 from documents group by lang),
       (select unnest(['v1.10.0', 'v1.2.0']) version)"""


@query("version_tag", _VERSIONS_SQL)
def version_tag(spark, sf):
    """Tag all cases, then a smaller set, and list the versions. A repeated tag is refused.

    The first tag meets what a call that died ahead of its version row would have left.
    """
    path = new_table_path(spark, "versions")
    rows = _versioned(spark, sf)
    left = rows.withColumn("version", F.lit("v1.2.0"))
    left.unionByName(left).write.partitionBy("dataset", "version").parquet(f"{path}/case_versions")
    meta = rows.select("dataset").distinct().withColumn("type", F.lit("qa"))
    history.tag_version(rows, path, "v1.2.0", "2024-01-01T00:00:00+00:00", "all", meta)
    history.tag_version(_labelled(spark, sf), path, "v1.10.0", "2024-01-02T00:00:00+00:00", "labelled", meta)
    try:
        history.tag_version(rows, path, "v1.2.0", "2024-01-03T00:00:00+00:00", "again", meta)
    except ValueError:
        return history.list_versions(spark, path).select("dataset", "version", "case_count", "description", "type")
    raise AssertionError("the same version was tagged twice")


@query(
    "version_restore",
    "select lang dataset, count(*) cases, cast(sum(length(text)) as bigint) chars from documents group by lang",
)
def version_restore(spark, sf):
    """Tag the cases, overwrite the working set with fewer, restore it."""
    path, working = new_table_path(spark, "versions"), new_table_path(spark, "cases")
    rows = _versioned(spark, sf)
    history.tag_version(rows, path, "v1.0.0", "2024-01-01T00:00:00+00:00")
    _labelled(spark, sf).write.partitionBy("dataset").parquet(working)
    history.restore_version(spark, path, "v1.0.0", working)
    return spark.read.parquet(working).groupBy("dataset").agg(
        F.count("*").alias("cases"), F.sum(F.length("text")).alias("chars")
    )


@query(
    "version_meta",
    with_(
        "given as (select distinct lang dataset from documents)",
        "select dataset, case when dataset = 'en' then 'rag' else 'qa' end as type from given",
    ),
)
def version_meta(spark, sf):
    """Metadata of a version: its own where there is one, else that of the dataset."""
    current = _versioned(spark, sf).select("dataset").distinct().withColumn("type", F.lit("qa"))
    snapshot = current.select("dataset", F.when(F.col("dataset") == "en", "rag").alias("type"))
    return catalog.resolve_meta(snapshot, current)


@query(
    "assertion_export",
    with_(
        ASSERTIONS_SQL,
        """select doc_id, kind as type, array_to_string(list_transform(asserts, lambda a: a.t || '=' || coalesce(a.v, '')), '|') asserts from asserted""",
    ),
)
def assertion_export(spark, sf):
    """Write the assertion table as JSON lines and read it back."""
    path = new_table_path(spark, "tests")
    built = assertions.build_assertions(b.plain_cases(spark, sf))
    results.write_json_lines(built.select("type", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("description"), "vars", "assertions"), path)
    written = spark.read.schema("type string, description string, assertions array<struct<type:string,value:string>>").json(path)
    shown = F.transform("assertions", lambda a: F.concat(a["type"], F.lit("="), F.coalesce(a["value"], F.lit(""))))
    return written.select(F.substring("description", 5, 20).cast("long").alias("doc_id"), "type", F.array_join(shown, "|").alias("asserts"))


# --- raw result and trace scans ---------------------------------------------------------------------------------


def _outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Runner output documents: one per event, in the three accepted shapes, with fields missing."""
    e = b.table(spark, sf, "events")
    n, k = F.col("event_id"), F.get_json_object("props", "$.k")
    item = F.concat(
        F.lit('{"vars": {"user": "'), F.col("user_id").cast("string"), F.lit('", "k": '), k, F.lit('}, "provider": '),
        F.when(n % 4 == 0, F.concat(F.lit('{"id": "'), "event_type", F.lit('"}')))
        .when(n % 4 == 1, F.lit('""')).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"'))),
        F.when(n % 2 == 0, F.concat(F.lit(', "success": true, "latencyMs": '), k)).otherwise(""),
        F.when(n % 3 == 0, F.lit(', "score": 0.25, "cost": 0.5')).otherwise(""), F.lit("}"),
    )
    shape = (
        F.when(n % 3 == 0, F.concat(F.lit('{"results": {"results": ['), item, F.lit('], "stats": {"tokenUsage": {"total": '), k, F.lit(', "prompt": 2}}}}')))
        .when(n % 3 == 1, F.concat(F.lit('{"results": ['), item, F.lit("]}")))
        .otherwise(F.concat(F.lit("["), item, F.lit("]")))
    )
    return e.select(n.alias("run_id"), shape.alias("json"))


@query(
    "raw_result_scan",
    """select event_id run_id, 0::bigint ord, case event_id % 4 when 1 then 'unknown' else event_type end provider,
       substr(sha256('{"k": ' || json_extract_string(props, '$.k') || ', "user": "' || user_id || '"}'), 1, 16) key,
       event_id % 2 = 0 success,
       case when event_id % 3 = 0 then 0.25::double when event_id % 2 = 0 then 1.0 else 0.0 end::double score,
       case when event_id % 2 = 0 then cast(json_extract_string(props, '$.k') as int) else 0 end latency_ms,
       case when event_id % 3 = 0 then 0.5 else 0.0 end::double cost_usd from events""",
)
def raw_result_scan(spark, sf):
    return results.parse_results(_outputs(spark, sf)).drop("vars_json")


@query(
    "large_result_scan",
    """with e as (select *, event_id // 1000 run, row_number() over (partition by event_id // 1000 order by event_id) - 1 i from events)
       select 'run=' || run dataset, i ord, event_type provider,
              substr(sha256('{"k": ' || json_extract_string(props, '$.k') || ', "user": "' || user_id || '"}'), 1, 16) key,
              event_id % 2 = 0 success, case when event_id % 2 = 0 then 1.0 else 0.0 end::double score,
              max(i + 1) over (partition by run) total_tokens from e""",
)
def large_result_scan(spark, sf):
    """Documents of a thousand results each, written as one file a run and read by splits, with their token counts."""
    path = new_table_path(spark, "outputs")
    e, n = b.table(spark, sf, "events"), F.col("event_id")
    item = F.concat(
        F.lit('{"vars": {"user": "'), F.col("user_id").cast("string"), F.lit('", "k": '), F.get_json_object("props", "$.k"),
        F.lit('}, "provider": "'), "event_type", F.lit('", "note": "}, [\\" {"'), F.when(n % 2 == 0, ', "success": true').otherwise(""), F.lit("}"),
    )
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), item.alias("item")))), lambda x: x["item"]), ",")
    # a thousand events a document
    made = e.groupBy(F.floor(n / 1000).alias("run")).agg(listed.alias("items"), F.count("*").cast("string").alias("size"))
    shape = F.when(F.col("run") % 2 == 0, F.lit('{"results": {"results": [')).otherwise('{"results": {"x": {"results": [{}]}, "results": [')
    tail = F.concat(F.lit(']  , "stats": {"tokenUsage": {"total": '), "size", F.lit("}}}}"))
    made.select("run", F.concat(shape, "items", tail).alias("value")).write.partitionBy("run").text(path)
    rows, stats = results.load_results(spark, path)
    return rows.select("dataset", "ord", "provider", "key", "success", "score").join(stats.select("dataset", "total_tokens"), "dataset")


@query(
    "token_scan",
    """select event_id run_id, case when event_id % 3 = 0 then cast(json_extract_string(props, '$.k') as bigint) else 0 end total_tokens,
       case when event_id % 3 = 0 then 2 else 0 end::bigint prompt_tokens, 0::bigint completion_tokens from events""",
)
def token_scan(spark, sf):
    return results.parse_token_stats(_outputs(spark, sf))


def _trace_lines(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    head = _quoted(F.col("text"))
    good = F.concat(
        F.lit('{"task": '), head, F.lit(', "steps": [{"type": "thought", "content": "t"}, {"type": "tool_call", "tool": "s'),
        (n % 3).cast("string"), F.lit('", "arguments": {"a": 1}, "result": {"r": '), n.cast("string"),
        F.lit('}}, {"type": "answer", "content": '), head, F.lit('}], "metadata": {"tags": ["x"], "difficulty": "easy"}}'),
    )
    line = (
        F.when(n % 10 == 1, F.replace(good, F.lit('"thought"'), F.lit('"dream"')))
        .when(n % 10 == 2, F.concat(F.lit('{"task": 1, "steps": []}')))
        .when(n % 10 == 3, F.lit('{"task": "x"}'))
        .when(n % 10 == 4, F.lit("nope"))
        .otherwise(good)
    )
    return b.table(spark, sf, "documents").select("doc_id", line.alias("line"))


@query(
    "trace_scan",
    """select doc_id, case doc_id % 10 when 1 then 'steps: unknown step type or content' when 2 then 'task: not a string'
         when 3 then 'steps: not a list' when 4 then 'not a JSON object' end error,
       case when doc_id % 10 not in (1, 2, 3, 4) then text end answer,
       case when doc_id % 10 not in (1, 2, 3, 4) then '{"r":' || doc_id || '}' end result,
       case when doc_id % 10 not in (1, 2, 3, 4) then 5 end::int max_steps from documents""",
)
def trace_scan(spark, sf):
    """Trace lines validated, and the valid ones turned into test cases."""
    checked = results.validate_traces(_trace_lines(spark, sf))
    made = traces.trace_to_case(results.parse_traces(checked.filter(F.col("error").isNull())))
    e, none = F.col("expected"), F.lit(None).cast("string")
    found = made.select(
        "doc_id", none.alias("error"), e["answer"].alias("answer"), F.map_values("tools")[0]["response_json"].alias("result"),
        e["max_steps"].alias("max_steps"),
    )
    return found.unionByName(checked.filter(F.col("error").isNotNull()).select("doc_id", "error"), allowMissingColumns=True)


@query(
    "result_files",
    with_(
        b.SUMMARY_SQL,
        f"""select s.run_id, s.total, {rounded('pass_rate', 4)} pass_rate, n cases from summary s
            join (select run_id, count(*) n from fold group by 1) using (run_id)""",
    ),
)
def result_files(spark, sf):
    """Write run summaries and case rows as JSON lines, half of the runs, the others, and the first half again; read them back."""
    from scorelake.operators.fold import fold_providers

    path = new_table_path(spark, "results")
    folded = fold_providers(b.raw_results(spark, sf))
    half = F.col("run_id").substr(-1, 1).isin("1", "3", "5", "7", "9")
    for part in (half, ~half, half):
        results.write_results(summary.summarize_runs(folded).filter(part), folded.filter(part), path)
    runs = spark.read.schema("run_id string, total long, pass_rate double, dataset string").json(f"{path}/runs")
    rows = spark.read.schema("key long, run_id string, dataset string").json(f"{path}/cases")
    return runs.select("run_id", "total", "pass_rate").join(rows.groupBy("run_id").agg(F.count("*").alias("cases")), "run_id")


@query(
    "document_files",
    r"""select lang, cast(sum(length(regexp_replace(text, '\s', '', 'g'))) as bigint) chars,
        cast(sum(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')))) as bigint) lines from documents group by lang""",
)
def document_files(spark, sf):
    """Write documents as text files by language, beside files of another suffix, and scan the folder."""
    root = new_table_path(spark, "files")
    rows = b.table(spark, sf, "documents").select("lang", "text")
    rows.write.partitionBy("lang").option("maxRecordsPerFile", 500).text(root)
    rows.select("lang").distinct().write.json(f"{root}/other")
    found = require_documents(read_documents(spark, root), root)
    lang = F.regexp_extract("source", "/lang=([^/]+)/", 1)
    full = F.filter(F.split("content", "\n"), lambda x: x.rlike(r"\S"))
    return found.groupBy(lang.alias("lang")).agg(
        F.sum(F.length(F.regexp_replace("content", r"\s", ""))).alias("chars"), F.sum(F.size(full)).alias("lines")
    )


@query(
    "object_documents",
    r"""select lang, count(distinct doc_id // 100) objects, cast(sum(length(regexp_replace(text, '\s', '', 'g'))) as bigint) chars
        from documents where lang like 'e%' group by lang""",
)
def object_documents(spark, sf):
    """Documents as objects of a tree, a hundred at most in one, and those of a URI's prefix, listed and read."""
    root = new_table_path(spark, "objects")
    rows = b.table(spark, sf, "documents").select("lang", F.floor(F.col("doc_id") / 100).alias("part"), "text")
    rows.repartition("lang", "part").write.partitionBy("lang", "part").text(root)
    uri = f"{root if '://' in root else 'file://' + root}/lang=e"
    lang = F.regexp_extract("source", "/lang=([^/]+)/", 1).alias("lang")
    keys, found = scan_objects(spark, uri)
    listed = keys.groupBy(lang).agg(F.count("*").alias("objects"))
    chars = F.sum(F.length(F.regexp_replace("content", r"\s", ""))).alias("chars")
    return listed.join(found.groupBy(lang).agg(chars), "lang")


@query("first_cases", "select doc_id, lang from documents order by doc_id limit 50")
def first_cases(spark, sf):
    """The requested number of cases, first in order."""
    return documents.first_cases(b.table(spark, sf, "documents").select("doc_id", "lang"), 50, ["doc_id"])


@query(
    "display_times",
    "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') shown from events",
)
def display_times(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return b.table(spark, sf, "events").select("event_id", display.display_time(iso).alias("shown"))
