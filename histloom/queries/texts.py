"""Queries on texts, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from histloom import constants as K
from histloom.functions import documents as D
from histloom.functions import text as T
from histloom.functions import web as W
from histloom.operators.lookups import each
from histloom.plans import pages as P
from histloom.queries import sql as S
from histloom.queries.registry import query, table, texts


def docs(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text")


SENTS = f'sents as (select doc_id, "text", {S.sentences(chr(34) + "text" + chr(34))} sents from documents)'
EACH = f"{SENTS}, each as (select doc_id, unnest(range(0, len(sents))) pos, unnest(sents) s from sents)"


@query("sentences", f"with {EACH} select doc_id, pos::INT pos, s from each")
def sentences(spark, sf):
    return each(docs(spark, sf), T.sentences(F.col("text")), ["doc_id"], item="s")


@query("sentence_score_class", f"with {EACH} select doc_id, pos::INT pos, {S.score_by_class('s')} score from each")
def sentence_score_class(spark, sf):
    return sentences(spark, sf).select("doc_id", "pos", T.sentence_score_by_class(F.col("s")).alias("score"))


@query("sentence_score_match", f"with {EACH} select doc_id, pos::INT pos, {S.score_by_match('s')} score from each")
def sentence_score_match(spark, sf):
    return sentences(spark, sf).select("doc_id", "pos", T.sentence_score_by_match(F.col("s")).alias("score"))


@query("excerpt", f"""with {S.with_excerpt("documents", '"text"')} select doc_id, review_excerpt excerpt from cut""")
def excerpt(spark, sf):
    return T.with_excerpt(docs(spark, sf), "text", "excerpt").select("doc_id", "excerpt")


@query(
    "excerpt_by_class",
    f"""with {S.with_excerpt("documents", '"text"', S.score_by_class, 400)} select doc_id, review_excerpt excerpt from cut""",
)
def excerpt_by_class(spark, sf):
    rows = T.with_excerpt(docs(spark, sf), "text", "excerpt", max_chars=400, score=T.sentence_score_by_class)
    return rows.select("doc_id", "excerpt")


_WORDS = ["ould", "ing the", "sión", "eaux "]


@query(
    "keyword_sentence_filter",
    f"""with said as (select doc_id, "text" || case when doc_id % 3 = 0 then ' He likes it.' || chr(10) || 'They enjoy Browsing and a good Product''s rating. Fine.' else '' end as t from documents),
    parts as (select doc_id, string_split(regexp_replace(t, '([.!?]){S.WS}+', '\\1' || chr(1), 'g'), chr(1)) p from said),
    kept as (select doc_id, list_filter(p, lambda s: {S.strip('s')} <> '' and not regexp_matches(lower(s), '{"|".join([*K.NON_INFERABLE, *_WORDS]).replace("'", "''")}')) k from parts)
    select doc_id, case when len(k) > 0 then array_to_string(k, ' ') else 'none' end as text from kept""",
)
def keyword_sentence_filter(spark, sf):
    """Every third document says something that purchases cannot show."""
    more = F.when(F.col("doc_id") % 3 == 0, " He likes it.\nThey enjoy Browsing and a good Product's rating. Fine.").otherwise("")
    told = F.concat("text", more)
    return docs(spark, sf).select("doc_id", T.without_keyword_sentences(told, [*K.NON_INFERABLE, *_WORDS], "none").alias("text"))


@query(
    "normalize_text",
    f"""select doc_id, md5(lower({S.squeeze('"text"')})) as text, left(lower({S.squeeze('"text"')}), 24) short from documents""",
)
def normalize_text(spark, sf):
    rows = docs(spark, sf).withColumn("n", T.normalize_text(F.col("text")))
    return rows.select("doc_id", F.md5("n").alias("text"), T.normalize_text(F.col("text"), 24).alias("short"))


@query("strip_ansi", """select conv_id, turn, "text" from conversations""")
def strip_ansi(spark, sf):
    colored = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x1b[0m\x1bM"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.strip_ansi(colored).alias("text"))


@query(
    "first_n_lines",
    """select doc_id, array_to_string(list_filter(string_split("text", chr(10))[1:5], lambda x: trim(x) <> ''), chr(10)) as text from documents""",
)
def first_n_lines(spark, sf):
    return docs(spark, sf).select("doc_id", T.first_lines(F.col("text"), 5).alias("text"))


@query(
    "truncate_tokens",
    f"""select doc_id, array_to_string(string_split({S.squeeze('"text"')}, ' ')[1:50], ' ') as text from documents""",
)
def truncate_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", T.truncate_tokens(F.col("text"), 50).alias("text"))


CHUNKS = r"""pieces as (select doc_id, case when "text" = '' then [''] else
  regexp_extract_all("text", '(?s).{500}.{523}[^ \t\r\n]*[ \t\r\n]|(?s).+') end c from documents)"""


@query(
    "chunk_documents",
    f"with {CHUNKS}, each as (select doc_id, unnest(range(0, len(c))) pos, unnest(c) chunk from pieces) select doc_id, pos::INT pos, chunk from each",
)
def chunk_documents(spark, sf):
    return each(docs(spark, sf), D.chunks(F.col("text")), ["doc_id"], item="chunk")


def _found_sql(pattern):
    words = "' ' || lower(trim(regexp_replace(chunk, '[^\\p{L}\\p{N}_]+', ' ', 'g'))) || ' '"
    return f"""with {CHUNKS}, each as (select doc_id, len(c) n, unnest(range(0, len(c))) pos, unnest(c) chunk from pieces),
    hits as (select doc_id, n, pos, (pos - doc_id % n + n) % n step from each where regexp_matches({words}, '{pattern}'))
    select p.doc_id, min_by(pos, step)::INT pos from pieces p left join hits h on h.doc_id = p.doc_id group by p.doc_id"""


@query("find_chunk", _found_sql(" that.* of the.* "))
def find_chunk(spark, sf):
    rows = docs(spark, sf).withColumn("c", D.chunks(F.col("text")))
    start = F.pmod(F.col("doc_id"), F.size("c"))
    return rows.select("doc_id", D.find_chunk(F.col("c"), "That* of, the *", start).alias("pos"))


# --- pages -----------------------------------------------------------------------------------
def marked_pages(spark, sf):
    """Pages with meta tags, linked data and microdata put into their head and body."""
    key = F.col("page_id").cast("string")
    head = F.concat(
        F.lit('<meta name="id" content="'), key, F.lit('"><meta property=og:type content=\'a &amp; b\'>'),
        F.lit('<meta name="id" property="x" content="last '), key, F.lit('"><meta name="none">'),
        F.lit('<script type="application/ld+json"> {"n": '), key, F.lit("} </script>"),
        F.when(F.col("page_id") % 3 == 0, '<script type="application/ld+json">{"b": 1}</script>')
        .when(F.col("page_id") % 3 == 1, "")
        .otherwise(""),
    )
    item = F.concat(
        F.lit('<div itemscope itemtype="Product"><span itemprop="name">Item <b>'), key,
        F.lit('</b></span><meta itemprop="sku" content="s'), key,
        F.lit('"><div itemprop="offer" itemscope itemtype="Offer"><a itemprop="url" href="/o/'), key,
        F.lit('">x</a><i itemprop="price">5</i><i itemprop="price">6</i></div></div>'),
    )
    html = F.replace(F.col("html"), F.lit("</head>"), F.concat(head, F.lit("</head>")))
    html = F.replace(html, F.lit("</body>"), F.concat(item, F.lit("</body>")))
    return texts(spark, sf, "pages", "page_id", "url", "html").select("page_id", "url", html.alias("html"))


@query(
    "page_meta",
    """select page_id, 'id' as key, 'last ' || page_id as value from pages where contains(html, '</head>')
    union all select page_id, 'og:type', 'a & b' from pages where contains(html, '</head>')""",
)
def page_meta(spark, sf):
    rows = each(marked_pages(spark, sf), F.map_entries(W.meta_tags(F.col("html"))), ["page_id"], item="m")
    return rows.select("page_id", "m.key", "m.value")


@query(
    "page_jsonld",
    """select page_id, 0::INT pos, '{"n": ' || page_id || '}' block, page_id % 3 <> 0 parsed from pages where contains(html, '</head>')
    union all select page_id, 1, '{"b": 1}', false from pages where page_id % 3 = 0 and contains(html, '</head>')""",
)
def page_jsonld(spark, sf):
    rows = each(marked_pages(spark, sf), W.linked_data(F.col("html")), ["page_id"], item="b")
    return rows.select("page_id", "pos", "b.block", "b.parsed")


@query(
    "page_microdata",
    """with p as (select page_id from pages where contains(html, '</body>')) select * from (
    select page_id, 0::INT item, null::INT parent, null::VARCHAR parent_prop, 'Product' item_type, 'name' prop, 0::INT pos, 'Item ' || page_id as value from p
    union all select page_id, 0, null, null, 'Product', 'sku', 1, 's' || page_id from p
    union all select page_id, 1, 0, 'offer', 'Offer', 'url', 0, '/o/' || page_id from p
    union all select page_id, 1, 0, 'offer', 'Offer', 'price', 1, '5' from p
    union all select page_id, 1, 0, 'offer', 'Offer', 'price', 2, '6' from p)""",
)
def page_microdata(spark, sf):
    return P.microdata(marked_pages(spark, sf))


_BODY = "case when regexp_extract(html, '(?is)<body[^>]*>(.*)', 1) <> '' then regexp_extract(html, '(?is)<body[^>]*>(.*)', 1) else html end"
_BARE = f"regexp_replace(regexp_replace({_BODY}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g'), '{S.WS}+', ' ', 'g')"
_LINES = f"regexp_replace(regexp_replace({_BARE}, '(?i)</?({'|'.join(K.BLOCK_TAGS)})([\\s/][^>]*)?>', chr(10), 'g'), '</?[A-Za-z!][^>]*>', '', 'g')"
_PLAIN = f"replace(replace(replace(replace(replace(replace({_LINES}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"
PAGE_TEXT = S.strip(f"array_to_string(list_filter(string_split({_PLAIN}, chr(10)), lambda x: {S.strip('x')} <> ''), chr(10))")


@query("page_text", f"select page_id, {PAGE_TEXT} as text from pages")
def page_text(spark, sf):
    return texts(spark, sf, "pages", "page_id", "html").select("page_id", W.page_text(F.col("html")).alias("text"))


@query(
    "read_pages",
    f"""with texts as (select page_id, url, {PAGE_TEXT} body from pages), links as (
      select page_id // 4 request_id, 0 pos, 'http://none/' || (page_id // 4) url, null::VARCHAR body from pages where page_id % 4 = 0
      union all select page_id // 4, page_id % 4 + 1, url, body from texts)
    select request_id, string_agg('--- Content from ' || url || ' ---' || chr(10) || coalesce(body, 'Error: page not found') ||
      chr(10) || chr(10), '' order by pos) as text from links where pos < 3 group by request_id""",
)
def read_pages(spark, sf):
    pages = texts(spark, sf, "pages", "page_id", "url", "html")
    request = F.floor(F.col("page_id") / 4).alias("request_id")
    asked = pages.groupBy(request).agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("p"))
    unknown = F.concat(F.lit("http://none/"), F.col("request_id").cast("string"))
    links = F.concat(F.array(unknown), F.transform("p", lambda x: x["url"]))
    return P.read_pages(asked.select("request_id", links.alias("links")), pages)


_RULES = {"http://": "allowed", ".example.org": "blocked", "/en/": "blocked", "https://m.": "allowed"}
_BLOCKED = ["ref=x"]


def _policy_sql():
    merged = {**_RULES, **{b: "blocked" for b in _BLOCKED}}
    cases = " ".join(f"when contains(url, '{u}') then {'true' if s == 'allowed' else 'false'}" for u, s in merged.items())
    return f"select page_id, case {cases} else true end allowed, ends_with(lower(url), '.pdf') pdf from pages"


@query("url_policy", _policy_sql())
def url_policy(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", W.url_allowed(url, W.url_rules(_RULES, _BLOCKED)).alias("allowed"), W.is_pdf(url).alias("pdf")
    )


@query(
    "url_policy_table",
    """with given as (select url, case when page_id % 2 = 0 then 'blocked' else 'allowed' end status, page_id ord from pages where length(url) % 3 = 0
      union all select 'n_' || n_nationkey || '/', 'blocked', 1000000 + n_nationkey from nation
      union all select '.com/en/', 'blocked', 2000000 union all select 'net', 'allowed', 2000001 union all select 'in none of them', 'blocked', 2000002),
    rules as (select url, min(ord) ord, arg_max(status, ord) status from given group by url),
    met as (select page_id, max(case when r.url = p.url then status end) exact, arg_min(status, ord) partly
      from pages p join rules r on contains(p.url, r.url) group by page_id)
    select page_id, coalesce(coalesce(exact, partly) = 'allowed', true) allowed from pages left join met using (page_id)""",
)
def url_policy_table(spark, sf):
    """Rules from a third of all pages, some short ones, and one that is a piece of very many URLs."""
    pages = table(spark, sf, "pages")
    key = F.col("page_id")
    status = F.when(key % 2 == 0, "blocked").otherwise("allowed")
    exact = pages.filter(F.length("url") % 3 == 0).select("url", status.alias("status"), key.alias("ord"))
    n = F.col("n_nationkey")
    partly = table(spark, sf, "nation").select(
        F.concat(F.lit("n_"), n.cast("string"), F.lit("/")).alias("url"), F.lit("blocked").alias("status"), (n + 1_000_000).cast("long").alias("ord")
    )
    common = [(".com/en/", "blocked", 2_000_000), ("net", "allowed", 2_000_001), ("in none of them", "blocked", 2_000_002)]
    rules = exact.unionByName(partly).unionByName(spark.createDataFrame(common, "url string, status string, ord long"))
    return W.allowed_by_table(pages.select("page_id", "url"), "url", "page_id", rules).select("page_id", "allowed")


def elements(spark, sf):
    """Elements from the links of a page, with tags, roles and flags set by position."""
    anchors = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    pos = F.col("pos")
    pages = texts(spark, sf, "pages", "page_id", "html").withColumn("a", anchors)
    rows = each(pages, F.concat("a", "a", "a", "a"), ["page_id"], item="t")
    return rows.select(
        "page_id",
        "pos",
        (pos + 100).alias("id"),
        F.when(pos % 4 == 1, "input").when(pos % 4 == 2, "button").when(pos % 4 == 3, "nav").otherwise("a").alias("tag"),
        F.when(pos % 4 == 1, "textbox").when(pos % 4 == 2, "button").when(pos % 4 == 3, "menu").otherwise("link").alias("role"),
        F.when(pos % 5 == 0, "").when(pos % 5 == 1, F.concat(F.lit(" Search  "), F.col("t"))).otherwise(F.col("t")).alias("text"),
        F.when(pos % 10 == 0, "Add to Cart now").alias("aria_label"),
        (pos % 7 != 3).alias("visible"),
        (pos % 2 == 0).alias("interactive"),
        (pos % 3 == 0).alias("in_form"),
        (pos == 4).alias("focused"),
        (pos % 6 == 5).alias("cta"),
    )


_NORM = f"left(lower({S.squeeze('x')}), 24)"
ELEMENTS = f"""anchors as (select page_id, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) a from pages),
four as (select page_id, list_concat(list_concat(a, a), list_concat(a, a)) a from anchors),
rows_ as (select page_id, unnest(range(0, len(a))) pos, unnest(a) t from four),
els as (select page_id, pos, (pos + 100)::INT id, (['a', 'input', 'button', 'nav'])[pos % 4 + 1] tag,
  (['link', 'textbox', 'button', 'menu'])[pos % 4 + 1] as role,
  case when pos % 10 = 0 then 'Add to Cart now' when pos % 5 = 0 then '' when pos % 5 = 1 then ' Search  ' || t else t end x,
  pos % 7 <> 3 visible from rows_),
normed as (select *, {_NORM} as text from els),
scored as (select *, (case when role in ('link', 'textbox', 'button') then 3 else 0 end + case when tag in ('input', 'button') then 2 else 0 end
  + case when pos % 3 = 0 then 2 else 0 end + case when pos = 4 then 2 else 0 end + case when pos % 6 = 5 then 2 else 0 end
  + case when regexp_matches(text, '{"|".join(K.ACTION_WORDS)}') then 3 else 0 end
  + case when tag = 'input' and (contains(text, 'search') or text = '') then 10 when tag = 'input' then 5 else 0 end
  + case when visible and pos % 2 = 0 then 1 else 0 end)::INT score from normed),
top as (select *, row_number() over (partition by page_id order by score desc, pos) rn from scored where visible
  qualify rn <= 16)"""


@query("salience_score", f"with {ELEMENTS} select page_id, pos::INT pos, score from scored")
def salience_score(spark, sf):
    return elements(spark, sf).select("page_id", "pos", W.salience_score().alias("score"))


@query(
    "salience_topk",
    f"""with {ELEMENTS} select page_id, rn::INT rn, id, score, (case tag when 'a' then 0 when 'button' then 1 when 'input' then 2 else -1 end)::INT tag_code,
    (case role when 'link' then 0 when 'button' then 1 when 'textbox' then 2 else -1 end)::INT role_code, text, left(md5(text), 3) hash from top""",
)
def salience_topk(spark, sf):
    return P.top_elements(elements(spark, sf))


@query(
    "element_lines",
    f"""with {ELEMENTS} select page_id, 'ELEMENTS (use numbered markers in screenshot):' || chr(10) ||
    case when page_id % 2 = 0 then 'NEW: [1, 2]' || chr(10) else '' end ||
    case when page_id % 2 = 0 then 'REMOVED: [7]' || chr(10) else '' end ||
    string_agg(id || ': ' || case when tag = 'nav' then '?' else tag end || case when tag = 'input' and (contains(text, 'search') or text = '') then ' 🔍SEARCH'
      when tag = 'input' then ' INPUT' when tag = 'button' then ' BTN' when tag = 'a' then ' LINK' else '' end ||
      case when text <> '' then ', ''' || left(text, 30) || '''' else '' end, chr(10) order by rn) as text from top group by page_id""",
)
def element_lines(spark, sf):
    delta = table(spark, sf, "pages").filter("page_id % 2 = 0").select(
        "page_id", F.array(F.lit(1), F.lit(2)).alias("added"), F.array(F.lit(7)).alias("removed")
    )
    return P.element_lines(P.top_elements(elements(spark, sf)), delta)
