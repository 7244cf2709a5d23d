"""The registered queries as DuckDB SQL, written from the rules and not from the plans.

Where the engine derives variants and joins, the SQL compares every query word with every product.
"""

from __future__ import annotations

from . import data


def _text(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_text(v) if v is None or isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def _count(text: str, pattern: str) -> str:
    m = len(pattern)
    if not m:
        return "0"
    return f"len(list_filter(range(1, greatest(length({text}) - {m} + 2, 1)), lambda i: substr({text}, i, {m}) = {_text(pattern)}))"


def _sums(text: str, patterns) -> str:
    return ", ".join(f"sum({_count(text, p)})::BIGINT AS p{i}" for i, p in enumerate(patterns))


def _rows(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES {_values(rows)})"


QUERIES = _rows("q", "query_id, query_text", data.QUERIES)
INTENT = _rows("intent", "word, category", [(w, c) for c, ws in data.INTENT.items() for w in ws])
SYNONYMS = _rows("syn", "word, cat", [(w, c) for c, ws in data.SYNONYMS.items() for w in ws])

CATALOG = f"""
cat AS (
  SELECT p_partkey AS corpus_pos, p_name AS product_name, p_brand AS brand, p_type AS rec_category, p_size::DOUBLE AS rating_num,
         {_norm('p_name')} AS name_norm, {_norm('p_brand')} AS brand_norm, {_norm('p_type')} AS category_norm,
         {_norm("concat_ws(' ', p_name, p_brand, p_type, 'size', p_size::VARCHAR)")} AS desc_norm
  FROM part
), cata AS (
  SELECT *, {_words('name_norm')} AS nt, {_words('brand_norm')} AS bt, {_words('desc_norm')} AS dt,
         ' ' || {_norm("concat_ws(' ', product_name, brand, rec_category, desc_norm)")} || ' ' AS phrase_text
  FROM cat
)"""

VOCAB = """
vocab AS (
  SELECT word, sum(n)::BIGINT AS doc_freq FROM (
    SELECT word, count(*) AS n FROM (
      SELECT DISTINCT corpus_pos, unnest(list_concat(nt, bt, string_split(category_norm, ' '), dt)) AS word FROM cata)
    WHERE length(word) >= 3 AND NOT regexp_matches(word, '[0-9]') GROUP BY word
    UNION ALL SELECT DISTINCT word, 1 FROM syn
    UNION ALL SELECT cat, count(*) FROM syn GROUP BY cat)
  GROUP BY word
)"""

TERMS = f"""
qt AS (
  SELECT query_id, query_text, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS term
  FROM (SELECT *, {_words(_norm('query_text'))} AS w FROM q) WHERE len(w) > 0
), fixed AS (
  SELECT term, arg_min(word, k) AS corrected, min(d) AS distance FROM (
    SELECT t.term, v.word, levenshtein(t.term, v.word) AS d,
           (levenshtein(t.term, v.word), -v.doc_freq, v.word) AS k
    FROM (SELECT DISTINCT term FROM qt WHERE length(term) >= 3 AND NOT regexp_matches(term, '[0-9]') AND term NOT IN (SELECT word FROM vocab)) t
    JOIN vocab v ON abs(length(t.term) - length(v.word)) <= 2)
  GROUP BY term HAVING min(d) <= CASE WHEN length(term) <= 4 THEN 1 ELSE 2 END
), ct AS (
  SELECT qt.query_id, qt.pos, qt.term, coalesce(f.corrected, qt.term) AS corrected, coalesce(f.distance, 0)::BIGINT AS distance
  FROM qt LEFT JOIN fixed f USING (term)
), ut AS (
  SELECT query_id, corrected AS term, min(pos) AS pos FROM ct GROUP BY query_id, corrected
), pq AS (
  SELECT query_id, string_agg(term, ' ' ORDER BY pos) AS phrase, count(*) AS n FROM ut GROUP BY query_id
), iq AS (
  SELECT query_id, arg_min(category, pos) AS intent FROM ut JOIN intent ON ut.term = intent.word GROUP BY query_id
), prep AS (
  SELECT pq.query_id, c.corrected_query, pq.phrase, pq.n, coalesce(iq.intent, '') AS intent
  FROM pq JOIN (SELECT query_id, string_agg(corrected, ' ' ORDER BY pos) AS corrected_query FROM ct GROUP BY query_id) c USING (query_id)
  LEFT JOIN iq USING (query_id)
)"""

SCORED = """
m AS (
  SELECT u.query_id, u.term, c.corpus_pos,
    len(list_filter(c.nt, lambda t: t = u.term
        OR (length(u.term) >= 3 AND starts_with(t, u.term) AND regexp_full_match(substr(t, length(u.term) + 1), '[0-9]+'))
        OR (length(u.term) >= 4 AND (t = u.term || 's' OR u.term = t || 's' OR suffix(t, u.term))))) > 0 AS f_name,
    list_contains(c.bt, u.term) AS f_brand,
    c.category_norm <> '' AND (u.term = c.category_norm
        OR (length(u.term) >= 4 AND (u.term = c.category_norm || 's' OR c.category_norm = u.term || 's'))
        OR EXISTS (SELECT 1 FROM syn WHERE syn.word = u.term AND syn.cat = c.category_norm)) AS f_category,
    list_contains(c.dt, u.term) OR (length(u.term) >= 4 AND (list_contains(c.dt, u.term || 's')
        OR (suffix(u.term, 's') AND list_contains(c.dt, left(u.term, length(u.term) - 1))))) AS f_desc
  FROM ut u CROSS JOIN cata c
), per AS (
  SELECT query_id, corpus_pos,
    sum(100 * f_name::INT + 80 * f_brand::INT + 180 * f_category::INT + 10 * f_desc::INT) AS points,
    sum((f_name OR f_brand OR f_category)::INT) AS strong,
    sum((f_desc AND NOT (f_name OR f_brand OR f_category))::INT) AS weak
  FROM m GROUP BY query_id, corpus_pos
), sc AS (
  SELECT p.query_id, p.corpus_pos, c.product_name, c.rec_category, c.brand, c.rating_num,
    CASE WHEN strong = 0 AND weak = 0 AND r.intent = '' THEN 0 ELSE greatest(0,
      points
      + CASE WHEN c.name_norm = r.phrase THEN 300 WHEN contains(' ' || c.name_norm || ' ', ' ' || r.phrase || ' ') THEN 220 ELSE 0 END
      + CASE WHEN r.n <= 1 THEN 0 WHEN strong = r.n THEN 200 WHEN strong + weak = r.n THEN 150 ELSE 0 END
      + CASE WHEN r.intent = '' THEN 0 WHEN lower(r.intent) = lower(c.rec_category) THEN 250 ELSE -180 END
      + CASE WHEN contains(c.phrase_text, ' ' || r.phrase || ' ') THEN 50 ELSE 0 END) END::BIGINT AS score
  FROM per p JOIN cata c USING (corpus_pos) JOIN prep r USING (query_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rating_num DESC, lower(product_name), corpus_pos) AS rank,
         count(*) OVER (PARTITION BY query_id) AS total_matches
  FROM sc WHERE score > 0
)"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


SEARCH = _with(QUERIES, INTENT, SYNONYMS, CATALOG, VOCAB, TERMS, SCORED)

_LIMIT = "CASE WHEN length(term) <= 2 OR regexp_matches(term, '[0-9]') THEN 0 WHEN length(term) <= 8 THEN 1 ELSE 2 END"


def _fuzzy(asked: str) -> str:
    best = "(SELECT {f} FROM (SELECT unnest({l}) AS t, generate_subscripts({l}, 1) AS i) WHERE levenshtein(ft.term, t) <= ft.most)"
    return f""",
fq AS ({asked}),
ft AS (
  SELECT query_id, query_text, len(w) AS terms, generate_subscripts(w, 1) AS pos, unnest(w) AS term FROM (SELECT *, {_words(_norm('query_text'))} AS w FROM fq) WHERE len(w) > 0
), fl AS (SELECT *, {_LIMIT} AS most FROM ft
), tok AS (
  SELECT DISTINCT term, most, t, levenshtein(term, t) AS d FROM (SELECT DISTINCT term, most FROM fl), (SELECT DISTINCT unnest(list_concat(nt, dt)) AS t FROM cata)
  WHERE levenshtein(term, t) <= most
), nhit AS (
  SELECT fl.query_id, fl.pos, x.corpus_pos, min((k.d, x.i, k.t)) AS b
  FROM (SELECT corpus_pos, unnest(nt) AS t, generate_subscripts(nt, 1) AS i FROM cata) x JOIN tok k ON k.t = x.t JOIN fl ON fl.term = k.term GROUP BY ALL
), chit AS (
  SELECT fl.query_id, fl.pos, x.corpus_pos, min((k.d, x.i, k.t)) AS b
  FROM (SELECT corpus_pos, unnest(dt) AS t, generate_subscripts(dt, 1) AS i FROM cata) x JOIN tok k ON k.t = x.t JOIN fl ON fl.term = k.term
  WHERE fl.terms > 1 AND NOT EXISTS (SELECT 1 FROM nhit n WHERE n.query_id = fl.query_id AND n.pos = fl.pos AND n.corpus_pos = x.corpus_pos) GROUP BY ALL
), fz AS (
  SELECT h.query_id, h.corpus_pos, count(*) AS matched_terms, sum(b[1])::BIGINT AS distance, string_agg(b[3], ', ' ORDER BY pos) AS matched
  FROM (SELECT * FROM nhit UNION ALL SELECT * FROM chit) h GROUP BY h.query_id, h.corpus_pos
), fs AS (
  SELECT z.*, s.terms, c.product_name,
    greatest(0.0, least(100.0, matched_terms / s.terms * 100.0 - distance * 5.0 + CASE WHEN contains(lower(c.product_name), lower(s.query_text)) THEN 30.0 ELSE 0.0 END))::DOUBLE AS score
  FROM fz z JOIN (SELECT DISTINCT query_id, query_text, terms FROM ft) s USING (query_id) JOIN cata c USING (corpus_pos)
  WHERE matched_terms >= CASE WHEN s.terms >= 3 THEN 2 ELSE 1 END
), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_pos) AS rank FROM fs)
SELECT query_id::BIGINT AS query_id, rank, corpus_pos, product_name, matched, distance, matched_terms, terms::BIGINT AS terms, score, format('{{:.2f}}', score) AS score_text
FROM fr WHERE rank <= 10"""


_TRIM = r"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def _trim(x: str) -> str:
    return _TRIM.format(x=x)


def _grouped(x: str) -> str:
    """Digits in Indian groups, by cutting from the end."""
    d = f"replace({x}, ',', '')"
    head = f"left({d}, length({d}) - 3)"
    pairs = f"list_transform(range(0, (length({d}) - 2)::BIGINT // 2), lambda k: substr({head}, greatest(length({head}) - 2 * k - 1, 1)::BIGINT, least(2, length({head}) - 2 * k)::BIGINT))"
    return f"CASE WHEN NOT regexp_full_match({x}, '[0-9][0-9,]*') THEN {x} WHEN length({d}) <= 3 THEN {d} ELSE array_to_string(list_reverse({pairs}), ',') || ',' || right({d}, 3) END"


_PRICE = f"""
  SELECT id, CASE WHEN t0 = '' THEN '' ELSE 'INR ' || {_grouped('t3')} END AS shown FROM (
    SELECT *, {_trim("regexp_replace(t2, '^(?i:inr)', '')")} AS t3 FROM (
      SELECT *, {_trim("regexp_replace(t1, '^(?i:rs[.]?)', '')")} AS t2 FROM (
        SELECT *, {_trim("regexp_replace(t0, '^[₹?]', '')")} AS t1 FROM (SELECT *, {_trim("coalesce(price, '')")} AS t0 FROM p))))"""


def _chain(subject: str, rules, otherwise: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({subject}, {_text(p)})" for p in parts) + f" THEN {_text(label)}" for label, parts in rules)
    return f"CASE {whens} ELSE {otherwise} END"


def _classify() -> str:
    from ..functions.dictionaries import CATEGORIES, FIELD_RULES, NAME_RULES

    field = _trim("coalesce(field, '')")
    same = " ".join(f"WHEN lower({field}) = {_text(c.lower())} THEN {_text(c)}" for c in CATEGORIES)
    plain = f"CASE WHEN {field} = '' THEN 'Other' ELSE {field} END"
    return f"CASE {same} ELSE {_chain(_norm('name'), NAME_RULES, _chain(_norm(field), FIELD_RULES, plain))} END"


def _brands() -> str:
    from ..functions.dictionaries import BRANDS

    return _chain("lower(name)", [(b, p) for p, b in BRANDS], "''")


_PART_INDEX = f"(SELECT corpus_pos, unnest(list_distinct(list_concat({_words(_norm('a'))}, {_words(_norm('b'))}))) AS word FROM src)"


def _prefix_products(source: str, asked) -> str:
    return f"""
WITH src AS ({source}), idx AS (SELECT * FROM {_PART_INDEX} WHERE length(word) >= 2),
{_rows('a', 'query_id, query_text', asked)},
parts AS (SELECT query_id, len(w) AS n, generate_subscripts(w, 1) AS part, unnest(w) AS p FROM (SELECT *, {_words(_norm('query_text'))} AS w FROM a) WHERE len(w) > 0),
hits AS (SELECT query_id, corpus_pos, any_value(n) AS n, count(DISTINCT part) AS got, min(CASE WHEN part = 1 THEN word END) AS first_word
         FROM parts JOIN idx ON starts_with(word, p) GROUP BY query_id, corpus_pos)
SELECT query_id::BIGINT AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY first_word, corpus_pos) AS rank, corpus_pos, count(*) OVER (PARTITION BY query_id) AS total
FROM hits WHERE got = n"""


_WORDS = r"""words AS (SELECT DISTINCT word FROM (SELECT regexp_replace(lower(w), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS word FROM (
  SELECT p_name AS w FROM part UNION ALL SELECT s_name FROM supplier UNION ALL SELECT c_name FROM customer)) WHERE word <> '')"""

_POOL = """pool AS (SELECT query_id, rank, product_name, rec_category AS category, brand, score FROM ranked WHERE rank <= 30)"""
_CANDIDATES = """
first_names AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(trim(product_name)) ORDER BY rank) AS k FROM pool),
cand AS (
  SELECT query_id, rank, trim(product_name) AS product_name, trim(category) AS category, trim(brand) AS brand, score, lower(trim(category)) AS category_key, lower(trim(brand)) AS brand_key,
         row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, count(*) OVER (PARTITION BY query_id) AS n
  FROM first_names WHERE k = 1
), labelled AS (
  SELECT *, first_value(category) OVER (PARTITION BY query_id, category_key ORDER BY rank) AS category_label,
         first_value(brand) OVER (PARTITION BY query_id, brand_key ORDER BY rank) AS brand_label FROM cand
)"""
_DECIDED = """
t AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, brand_key ORDER BY rank) <= 2 AS f1,
         row_number() OVER (PARTITION BY query_id, category_key ORDER BY rank) <= 2 AS f2 FROM labelled
), u AS (
  SELECT *, f1 AND sum(f1::INT) OVER (PARTITION BY query_id ORDER BY rank) <= 6 AS s1, f2 AND sum(f2::INT) OVER (PARTITION BY query_id ORDER BY rank) <= 6 AS s2, place <= 6 AS s3 FROM t
), d AS (
  SELECT *, CASE WHEN n1 >= least(6, n) THEN 1 WHEN n2 >= least(6, n) THEN 2 ELSE 3 END AS tier FROM (
    SELECT *, sum(s1::INT) OVER (PARTITION BY query_id) AS n1, sum(s2::INT) OVER (PARTITION BY query_id) AS n2 FROM u)
), dec AS (
  SELECT *, CASE tier WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END AS selected, CASE tier WHEN 1 THEN 6 WHEN 2 THEN 2 ELSE 6 END AS per_category, CASE tier WHEN 1 THEN 2 ELSE 6 END AS per_brand FROM d
)"""
RECOMMEND = SEARCH + ", " + _POOL + ", " + _CANDIDATES + ", " + _DECIDED



def _both_limits() -> str:
    """All choices of 1 to 6 of a pool's candidates with two of a category and of a brand at most, one size after the other.

    A choice is a bit per place; counts of categories and brands are two bits each. The greatest size wins, then the least
    number, whose highest bit is its worst place. A second tier without limits takes the first six.
    """
    fits = "(cs >> (2 * c)) & 3 < 2 AND (bs >> (2 * b)) & 3 < 2"
    take = "place AS last, bits + (1::BIGINT << place) AS bits, cs + (1::BIGINT << (2 * c)) AS cs, bs + (1::BIGINT << (2 * b)) AS bs"
    sizes = ["s0 AS MATERIALIZED (SELECT DISTINCT query_id, 0::BIGINT AS last, 0::BIGINT AS bits, 0::BIGINT AS cs, 0::BIGINT AS bs FROM own)"]
    sizes += [f"s{n} AS MATERIALIZED (SELECT query_id, {take} FROM s{n - 1} JOIN own USING (query_id) WHERE place > last AND {fits})" for n in range(1, 7)]
    best = " UNION ALL ".join(f"SELECT query_id, {n} AS n, min(bits) AS bits FROM s{n} GROUP BY query_id" for n in range(7))
    return (
        ", own AS MATERIALIZED (SELECT query_id, rank, product_name, place, dense_rank() OVER (PARTITION BY query_id ORDER BY category_key) - 1 AS c, dense_rank() OVER (PARTITION BY query_id ORDER BY brand_key) - 1 AS b, least(6, count(*) OVER (PARTITION BY query_id)) AS target FROM labelled), "
        + ", ".join(sizes)
        + f", best AS (SELECT query_id, max(n) AS n, arg_max(bits, n) AS bits FROM ({best}) GROUP BY query_id)"
        + """ SELECT query_id::BIGINT AS query_id, rank::BIGINT AS rank, product_name, CASE WHEN n >= target THEN 1 ELSE 2 END::BIGINT AS tier, target::BIGINT AS max_flow
        FROM own JOIN best USING (query_id) WHERE CASE WHEN n >= target THEN (bits >> place) & 1 = 1 ELSE place <= target END"""
    )


_GRAPH = """
WITH n AS (SELECT * FROM nation),
s AS (SELECT s_nationkey, count(*) % 7 + 1 AS c, max(s_suppkey % 4) AS m FROM supplier GROUP BY s_nationkey),
own AS (SELECT n_regionkey::VARCHAR AS graph_id, n_nationkey, coalesce(c, 2) AS c, coalesce(m, 1) AS m, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS v
        FROM n LEFT JOIN s ON n_nationkey = s_nationkey),
e AS (
  SELECT graph_id, 0::BIGINT AS src, v AS dst, c FROM own
  UNION ALL SELECT graph_id, v, 8 + n_nationkey % 3, m + 1 FROM own
  UNION ALL SELECT DISTINCT graph_id, 8 + n_nationkey % 3, 11, 4 FROM own
), edges AS (SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY src, dst) AS edge_pos, src::BIGINT AS src, dst::BIGINT AS dst, c::BIGINT AS capacity FROM e)"""
#: The least cut over all sets of inner vertices that lie on the source's side (a bit per vertex).
_MIN_CUT = """
, cuts AS (
  SELECT graph_id, x, sum(CASE WHEN (src = 0 OR (src < 11 AND (x >> (src - 1)) & 1 = 1)) AND NOT (dst < 11 AND (x >> (dst - 1)) & 1 = 1) THEN capacity ELSE 0 END) AS cut
  FROM edges CROSS JOIN (SELECT unnest(range(0, 1024)) AS x) GROUP BY graph_id, x)
SELECT graph_id, min(cut)::BIGINT AS max_flow FROM cuts GROUP BY graph_id"""


#: The texts written from `part`, as a catalogue: their description is what of a text is searched.
_SEARCHABLE = "'Product Name: ' || p_name || '   Brand : ' || p_brand || '  Category= ' || p_type || ' Selling Price - Rs. ' || floor(p_retailprice)::BIGINT || ' Average Rating: ' || (p_size % 5) || '.' || (p_size % 10) || '/5 Overview: A ' || p_name || ' of ' || p_type || ' Search Index:'"
_CLEAN = _SEARCHABLE + " || ' Primary Keywords: ' || p_name || ' Searchable Attributes: Size: ' || p_size"
TEXTS = CATALOG.replace("p_size::DOUBLE AS rating_num", "((p_size % 5) || '.' || (p_size % 10))::DOUBLE AS rating_num").replace(_norm("concat_ws(' ', p_name, p_brand, p_type, 'size', p_size::VARCHAR)"), _norm(_CLEAN))


def _first(value: str, where: str) -> str:
    """Of the first line that qualifies."""
    return f"arg_min({value}, i) FILTER ({where})"


def _hinted(hints) -> str:
    any_of = " OR ".join(f"contains(e_key, '{h}')" for h in hints)
    plain = " ".join(f"WHEN starts_with(low, '{h} ') THEN {_trim(f'substr(line, {len(h) + 1})')}" for h in hints)
    starts = " OR ".join(f"starts_with(low, '{h} ')" for h in hints)
    value = f"CASE WHEN e IS NOT NULL THEN e_rest ELSE CASE {plain} END END"
    return f"coalesce({_first(value, f'CASE WHEN e IS NOT NULL THEN e_rest <> {_text(str())} AND ({any_of}) ELSE {starts} END')}, '')"


def _parse_cases() -> str:
    from ..functions import fields

    skip, resume = (", ".join(_text(x) for x in v) for v in (fields._SKIP, fields._RESUME))
    place = lambda sign: f"coalesce(nullif(greatest(instr(line, '{sign}'), 1), 1), 100000000)"
    key = lambda at, line="line": _trim(f"left({line}, {at} - 1)")
    rest = lambda at, line="line": _trim(f"substr({line}, {at} + 1)")
    marked = "CASE WHEN instr(plain, ':') > 0 THEN instr(plain, ':') WHEN instr(plain, '-') > 1 THEN instr(plain, '-') END"
    meta = "|".join(fields.METADATA)
    info = "coalesce(nullif(overview, ''), nullif(m3, ''), nullif(m2, ''), nullif(m1, ''), '')"
    return f"""
WITH doc AS (SELECT 'p' || id::VARCHAR || '.txt' AS file_name, body0 || CASE WHEN p_size % 3 = 0 THEN '' ELSE chr(10) || p_name || chr(10) END AS content0 FROM {_turns(body=[c for _, c in data.DOCS])}),
doc1 AS (SELECT file_name, regexp_replace(content0, '\\r\\n?', chr(10), 'g') AS c FROM doc),
doc2 AS (SELECT file_name, string_split(CASE WHEN c = '' OR suffix(c, chr(10)) THEN c ELSE c || chr(10) END, chr(10)) AS l FROM doc1),
x AS (SELECT file_name, generate_subscripts(l, 1) AS i, unnest(l) AS raw FROM doc2),
y AS (SELECT *, {_trim("raw")} AS line FROM x),
z AS (SELECT *, lower(line) AS low, nullif(greatest(instr(line, ':'), 1), 1) AS c, nullif(least({place(":")}, {place("=")}, {place("-")}), 100000000) AS e,
        regexp_replace(regexp_replace(line, '^[-*•\\s]+', ''), '[*]', '', 'g') AS plain FROM y),
w AS (SELECT *, lower({key("c")}) AS c_key, {rest("c")} AS c_rest, lower({key("e")}) AS e_key, {rest("e")} AS e_rest, {marked} AS m, {_trim("regexp_replace(line, '^#+\\s*', '')")} AS title,
        max(CASE WHEN low IN ({skip}, {resume}) THEN i END) OVER (PARTITION BY file_name ORDER BY i) AS header,
        min(CASE WHEN starts_with(upper(line), 'BLOCK 3') THEN i END) OVER (PARTITION BY file_name) AS stop,
        min(CASE WHEN low = 'search index:' THEN i END) OVER (PARTITION BY file_name) AS opens FROM z),
v AS (SELECT *, lower({key("m", "plain")}) AS m_key, {rest("m", "plain")} AS m_rest,
        i < coalesce(stop, 100000000) AND low NOT IN ({skip}) AND NOT EXISTS (SELECT 1 FROM z WHERE z.file_name = w.file_name AND z.i = w.header AND z.low IN ({skip})) AS searched,
        min(CASE WHEN low = 'customer search queries:' AND i > opens THEN i END) OVER (PARTITION BY file_name) AS closes FROM w),
f AS (SELECT file_name,
    coalesce({_first("c_rest", "c_key = 'product name' AND c_rest <> ''")}, {_first("title", f"line <> '' AND NOT regexp_matches(lower(title), '^({meta})')")}, file_name) AS name,
    {_hinted(fields.BRAND)} AS brand0, {_hinted(fields.CATEGORY)} AS category0, {_hinted(fields.PRICE)} AS price, {_hinted(fields.RATING)} AS rating,
    coalesce({_first("c_rest", "c_key = 'overview'")}, '') AS overview,
    {_first("m_rest", "m_key = 'product description'")} AS m1, {_first("m_rest", "m_key = 'info'")} AS m2, {_first("m_rest", "m_key = 'description'")} AS m3,
    coalesce(string_agg(raw || ' ', '' ORDER BY i) FILTER (searched), '') AS searchable,
    coalesce(string_agg(regexp_replace(line, '^(\\[[0-9]+\\]|[0-9]+:)\\s*', '') || ' ', '' ORDER BY i) FILTER (searched AND NOT starts_with(low, 'common misspellings:')), '') AS clean,
    coalesce(string_agg(raw || ' ', '' ORDER BY i) FILTER (i > opens AND i < coalesce(closes, 100000000) AND low <> 'search index:'), '') AS index_text
  FROM v GROUP BY file_name),
p AS (SELECT file_name AS id, price FROM f), shown AS ({_PRICE}),
g AS (SELECT f.file_name, name, CASE WHEN brand0 <> '' THEN brand0 ELSE {_brands()} END AS brand, CASE WHEN category0 <> '' THEN category0 ELSE 'Other' END AS category, shown.shown AS price, rating, overview,
    CASE WHEN length({info}) > 120 THEN left({info}, 120) || '...' ELSE {info} END AS info, searchable, clean, index_text
  FROM f JOIN shown ON shown.id = f.file_name)
SELECT *, lower(concat_ws(' ', name, brand, category, price, rating, searchable)) AS search_text FROM g"""


def _in_values(name: str, values) -> str:
    return _rows("p", f"id, {name}", list(enumerate(values)))


def _turns(**columns) -> str:
    """The parts, each with one of the cases, in turn by key."""
    picks = ", ".join(f"[{', '.join(map(_text, v))}][p_partkey % {len(v)} + 1] AS {c}0" for c, v in columns.items())
    return f"(SELECT p_partkey AS id, p_name, p_size, {picks} FROM part)"


def _part_body() -> str:
    return """SELECT p_partkey AS corpus_pos, p_name, p_brand, p_type, p_size, p_retailprice::BIGINT AS price FROM part"""


def _windows(docs: str) -> str:
    """hits: every document's windows that are a pattern, counted."""
    return f"""WITH t AS ({docs}), patterns AS (
        SELECT DISTINCT unnest({_words(_norm('x'))}) AS s FROM (SELECT concat_ws(' ', p_name, p_type, p_brand) AS x FROM part UNION ALL SELECT text FROM benchmark)),
      lens AS (SELECT DISTINCT length(s) AS m FROM patterns WHERE length(s) >= 3),
      pieces AS (SELECT doc_id, lang, n, unnest(range(0, length(n) // 128 + 1)) AS k FROM t),
      cut AS (SELECT doc_id, lang, m, substr(n, k * 128 + 1, 127 + m) AS n FROM pieces, lens),
      w AS (SELECT doc_id, lang, unnest(list_transform(range(1, greatest(length(n) - m + 2, 1)), lambda i: substr(n, i, m))) AS s FROM cut),
      hits AS (SELECT doc_id, lang, s, count(*) AS c FROM w WHERE s IN (SELECT s FROM patterns) GROUP BY ALL) """


def oracle_sql() -> dict[str, str]:
    docs = f"SELECT doc_id, lang, {_norm('text')} AS n FROM documents"
    talk = f"SELECT conv_id, {_norm('text')} AS n FROM conversations"
    q = "query_id::BIGINT AS query_id"
    agree = " UNION ALL ".join(f"SELECT {i}::BIGINT AS pattern_no, sum({_count('n', p)})::BIGINT AS c FROM t" for i, p in enumerate(data.PATTERNS))
    searchable = "'Product Name: ' || p_name || '   Brand : ' || p_brand || '  Category= ' || p_type || ' Selling Price - Rs. ' || floor(p_retailprice)::BIGINT || ' Average Rating: ' || (p_size % 5) || '.' || (p_size % 10) || '/5 Overview: A ' || p_name || ' of ' || p_type || ' Search Index:'"
    out = {
        "norm_tokens": f"SELECT doc_id, length(n)::BIGINT AS norm_chars, len({_words('n')})::BIGINT AS tokens, md5(n) AS norm_md5 FROM ({docs})",
        "token_sets": f"""SELECT doc_id, len(t)::BIGINT AS distinct_tokens, len(list_filter(t, lambda w: regexp_matches(w, '[0-9]')))::BIGINT AS with_digit,
            len(list_filter(t, lambda w: regexp_full_match(w, '[0-9]+')))::BIGINT AS all_digits FROM (SELECT doc_id, list_distinct({_words('n')}) AS t FROM ({docs}))""",
        "doc_freq_vocab": f"SELECT word, count(*) AS doc_freq FROM (SELECT DISTINCT doc_id, unnest({_words('n')}) AS word FROM ({docs})) WHERE length(word) >= 3 AND NOT regexp_matches(word, '[0-9]') GROUP BY word",
        # However they arrived, the words are those of the documents as they are.
        "arriving_vocab": f"SELECT word, count(*) AS doc_freq FROM (SELECT DISTINCT doc_id, unnest({_words('n')}) AS word FROM ({docs})) WHERE length(word) >= 3 AND NOT regexp_matches(word, '[0-9]') GROUP BY word",
        "part_vocab": _with(SYNONYMS, CATALOG, VOCAB) + "SELECT word, doc_freq FROM vocab",
        "pattern_count_overlap": f"SELECT conv_id, {_sums('n', data.PATTERNS)} FROM ({talk}) GROUP BY conv_id",
        "pattern_total_by_lang": f"SELECT lang, {_sums('n', data.PATTERNS)} FROM ({docs}) GROUP BY lang",
        "pattern_two_plan_agree": f"WITH t AS ({talk}) SELECT pattern_no, c AS by_search, c AS by_position, true AS agree FROM ({agree})",
        "pattern_automaton": _windows(docs) + "SELECT s AS pattern, sum(c)::BIGINT AS occurrences, count(*) AS documents FROM hits GROUP BY s",
        "pattern_rolling_join": _windows(docs) + "SELECT lang, s AS pattern, sum(c)::BIGINT AS occurrences, count(*) AS documents FROM hits GROUP BY lang, s",
        "substring_documents": f"""WITH asked AS (SELECT substr(text, 20, 24) AS phrase FROM benchmark UNION SELECT unnest([{', '.join(map(_text, data.PHRASES))}])),
            hits AS (SELECT phrase, doc_id, text FROM documents, asked WHERE phrase <> '' AND contains(text, phrase)),
            split AS (SELECT *, string_split(text, phrase) AS parts FROM hits)
            SELECT phrase, doc_id, CASE WHEN phrase IN ('aaaa') THEN len(list_filter(range(1, length(text) - length(phrase) + 2), lambda i: substr(text, i, length(phrase)) = phrase)) ELSE len(parts) - 1 END::BIGINT AS occurrences FROM split""",
        "edit_distance_pairs": _with(_in_values("typed", data.MISSPELT)) + "SELECT p_name, typed, levenshtein(lower(p_name), lower(typed))::BIGINT AS distance FROM (SELECT DISTINCT p_name FROM part), p",
        "edit_distance_cases": _with("p AS (SELECT id, a0 AS a, b0 || ' ' || p_name AS b FROM " + _turns(a=[a for a, _ in data.DISTANCES], b=[b for _, b in data.DISTANCES]) + ")") + "SELECT id::BIGINT AS id, levenshtein(lower(coalesce(a, '')), lower(coalesce(b, '')))::BIGINT AS distance FROM p",
        "spell_correct": SEARCH + f"SELECT {q}, pos::BIGINT AS pos, term, corrected, distance FROM ct",
        "spell_report": SEARCH + f"SELECT {q}, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS change_no, pos::BIGINT AS pos, term, corrected, distance FROM ct WHERE term <> corrected",
        "spell_documents": f"""WITH v AS (SELECT word, count(*) AS f FROM (SELECT DISTINCT doc_id, unnest({_words('n')}) AS word FROM ({docs})) WHERE length(word) >= 3 AND NOT regexp_matches(word, '[0-9]') GROUP BY word),
            p(term) AS (VALUES ('thinor'), ('einex'), ('whhic'), ('ouer'), ('zzzzzzzz'))
            SELECT term, arg_min(word, (d, -f, word)) AS corrected, min(d)::BIGINT AS distance FROM (
              SELECT term, word, f, levenshtein(term, word) AS d FROM p JOIN v ON abs(length(term) - length(word)) <= 2 WHERE term NOT IN (SELECT word FROM v))
            GROUP BY term HAVING min(d) <= CASE WHEN length(term) <= 4 THEN 1 ELSE 2 END""",
        "query_intent": SEARCH + f"SELECT {q}, corrected_query, phrase, intent FROM prep",
        "algorithm_label": SEARCH + f"SELECT {q}, phrase, CASE WHEN length(phrase) <= 8 OR n <= 2 THEN 'KMP' ELSE 'Rabin-Karp' END AS algorithm FROM prep",
        "token_match_rules": SEARCH + f"SELECT {q}, term, corpus_pos, f_name::BIGINT AS name, f_brand::BIGINT AS brand, f_category::BIGINT AS category, f_desc::BIGINT AS description FROM m WHERE f_name OR f_brand OR f_category OR f_desc",
        "score_products": SEARCH + f"SELECT {q}, corpus_pos, score FROM sc WHERE score > 0",
        "phrase_in_name": SEARCH + f"SELECT {q}, count(*) AS products, sum((name_norm = phrase)::BIGINT)::BIGINT AS exact FROM prep JOIN cata ON contains(' ' || name_norm || ' ', ' ' || phrase || ' ') GROUP BY query_id",
        "rank_bounded": SEARCH + f"SELECT {q}, rank, corpus_pos, product_name, rec_category, brand, score FROM ranked WHERE rank <= 10",
        "rank_top10": SEARCH + f"SELECT {q}, rank, corpus_pos, product_name, rec_category, brand, score, total_matches FROM ranked WHERE rank <= 10",
        "rank_total_matches": SEARCH + f"SELECT DISTINCT {q}, total_matches FROM ranked",
        "fuzzy_search": _with(QUERIES, CATALOG) + _fuzzy("SELECT * FROM q"),
        "fallback_routing": SEARCH + _fuzzy(f"SELECT query_id, trim(query_text) AS query_text FROM q WHERE {_norm('query_text')} <> '' AND query_id NOT IN (SELECT query_id FROM ranked)"),
        "prefix_words": _with(_WORDS, _in_values("prefix", data.WORD_PREFIXES)) + f"SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY word) AS position, word FROM p JOIN words ON starts_with(word, {_trim('lower(prefix)')}) WHERE {_trim('prefix')} <> ''",
        "prefix_range_words": _with(_WORDS, _in_values("prefix", data.WORD_PREFIXES)) + f"SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY word) AS position, word FROM p JOIN words ON starts_with(word, {_trim('lower(prefix)')}) WHERE {_trim('prefix')} <> ''",
        "prefix_exists": _with(_WORDS, _in_values("prefix", data.WORD_PREFIXES)) + f"SELECT prefix, {_trim('prefix')} <> '' AND EXISTS (SELECT 1 FROM words WHERE starts_with(word, {_trim('lower(prefix)')})) AS found FROM p",
        "word_exists": _with(_WORDS, _in_values("word_asked", ["Red Plate", "supplier#000000001", "red plat", "", " hot ring "])) + f"SELECT word_asked AS word, {_trim('lower(word_asked)')} IN (SELECT word FROM words) AS found FROM p",
        "prefix_products_and": _prefix_products("SELECT p_partkey AS corpus_pos, p_name AS a, concat_ws(' ', p_name, p_brand, p_type, 'size', p_size::VARCHAR) AS b FROM part", data.PREFIXES),
        "parse_fields": f"""SELECT p_partkey AS corpus_pos, p_name AS product_name, p_brand AS brand, p_type AS category,
            'INR ' || {_grouped('floor(p_retailprice)::BIGINT::VARCHAR')} AS price, (p_size % 5) || '.' || (p_size % 10) || '/5' AS rating,
            ((p_size % 5) || '.' || (p_size % 10))::DOUBLE AS rating_num, 'A ' || p_name || ' of ' || p_type AS overview, 'A ' || p_name || ' of ' || p_type AS info FROM part""",
        "parse_sections": f"""SELECT p_partkey AS corpus_pos,
            {searchable} || '   Primary Keywords: ' || p_name || '   Common Misspellings: smlal Searchable Attributes:   [1] Size: ' || p_size || ' ' AS searchable,
            replace({searchable.replace("'   Brand : '", "' Brand : '")}, '  Category', '  Category') || ' Primary Keywords: ' || p_name || ' Searchable Attributes: Size: ' || p_size || ' ' AS clean,
            '  Primary Keywords: ' || p_name || '   Common Misspellings: smlal ' AS index_text FROM part""",
        "strip_misspellings": _with("p AS (SELECT id, t0 || ' ' || p_name AS t FROM " + _turns(t=STRIP) + ")") + """SELECT id::BIGINT AS id, CASE WHEN s = 0 THEN t ELSE left(t, s - 1) || coalesce(substr(r, nullif(least(
              coalesce(nullif(instr(r, 'search phrases:'), 0), 100000), coalesce(nullif(instr(r, 'search intent keywords:'), 0), 100000), coalesce(nullif(instr(r, 'related search terms:'), 0), 100000)), 100000)), '') END AS kept
            FROM (SELECT *, instr(t, 'common misspellings:') AS s, substr(t, greatest(instr(t, 'common misspellings:'), 1)) AS r FROM p)""",
        "price_indian_grouping": _with("p AS (SELECT id, price0 || id::VARCHAR AS price FROM " + _turns(price=data.PRICES) + ")") + f"SELECT id::BIGINT AS id, shown FROM ({_PRICE})",
        "price_grouping_parts": f"SELECT p_partkey, {_grouped('x')} AS grouped FROM (SELECT p_partkey, floor(p_retailprice * p_partkey)::BIGINT::VARCHAR AS x FROM part)",
        "rating_parse": _with("p AS (SELECT id, rating0 || p_size::VARCHAR AS rating FROM " + _turns(rating=data.RATINGS) + ")") + "SELECT id::BIGINT AS id, coalesce(try_cast(nullif(regexp_extract(rating, '[0-9]+([.][0-9]+)?'), '') AS DOUBLE), 0.0) AS value FROM p",
        "brand_infer": _with("p AS (SELECT id, name0 || ' ' || p_name AS name FROM " + _turns(name=data.NAMES) + ")") + f"SELECT id::BIGINT AS id, {_brands()} AS brand FROM p",
        "category_classify": _with("p AS (SELECT id, field0 AS field, name0 || ' ' || p_name AS name FROM " + _turns(field=[f for f, _ in data.FIELDS], name=[n for _, n in data.FIELDS]) + ")") + f"SELECT id::BIGINT AS id, {_classify()} AS category FROM p",
        "corpus_order": _with("p AS (SELECT p_name || '_' || id::VARCHAR || '_' || end0 AS file_name FROM " + _turns(end=data.FILE_NAMES) + ")") + "SELECT row_number() OVER (ORDER BY lower(file_name), file_name) - 1 AS corpus_pos, file_name FROM p",
        "corpus_pattern_counts": f"""SELECT {_sums('n', ['red', 'brand 1', 'g', 'smlal', 'unseen', 'hot ring'])} FROM (SELECT {_norm("p_name || ' ' || p_brand || ' ' || p_type || ' ' || " + searchable + " || ' Primary Keywords: ' || p_name || ' Common Misspellings: smlal Searchable Attributes: [1] Size: ' || p_size")} AS n FROM part)""",
        "corpus_prefix": _prefix_products("SELECT p_partkey AS corpus_pos, p_name AS a, 'primary keywords ' || p_name || ' common misspellings smlal' AS b FROM part", [(1, "key"), (2, "sml r"), (3, "hidden"), (4, "hot pl")]),
        "recommend_selected": RECOMMEND + f"SELECT {q}, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS slot, rank, product_name, category, CASE WHEN brand = '' THEN '-' ELSE brand END AS brand, coalesce(score::VARCHAR, '-') AS score, tier::BIGINT AS tier FROM dec WHERE selected",
        "recommend_tier": RECOMMEND + f"SELECT {q}, any_value(tier)::BIGINT AS tier, sum(selected::INT)::BIGINT AS max_flow, count(*) AS candidates FROM dec GROUP BY query_id",
        "recommend_rejected": RECOMMEND + f"""SELECT {q}, position, rank, product_name, CASE WHEN per_category < 6 AND used_c >= per_category THEN 'category limit reached (' || category_label || ')'
            WHEN per_brand < 6 AND used_b >= per_brand THEN 'brand limit reached (' || brand_label || ')' ELSE 'all 6 recommendation slots already used' END AS reason
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM (
              SELECT *, sum(selected::INT) OVER (PARTITION BY query_id, category_key) AS used_c, sum(selected::INT) OVER (PARTITION BY query_id, brand_key) AS used_b FROM dec) WHERE NOT selected) WHERE position <= 5""",
        "recommend_constraints": RECOMMEND + f"""SELECT {q}, kind, label, used, allowed::BIGINT AS allowed, used <= allowed AS ok FROM (
              SELECT query_id, 'total' AS kind, 'Total recommendations' AS label, count(*) AS used, 6 AS allowed FROM dec WHERE selected GROUP BY query_id
              UNION ALL SELECT query_id, 'category', 'Category: ' || any_value(category_label), count(*), any_value(per_category) FROM dec WHERE selected GROUP BY query_id, category_key
              UNION ALL SELECT query_id, 'brand', 'Brand: ' || any_value(brand_label), count(*), any_value(per_brand) FROM dec WHERE selected AND brand <> '' GROUP BY query_id, brand_key)""",
        "recommend_dedupe": RECOMMEND + f"SELECT {q}, rank, product_name, category_key, category_label, brand_label, place FROM labelled",
        "recommend_status": RECOMMEND + """SELECT q.query_id::BIGINT AS query_id, coalesce(s, 0)::BIGINT AS selected, coalesce(s, 0)::BIGINT AS max_flow,
            CASE WHEN s IS NULL THEN 'No products available for recommendation.' ELSE 'ok' END AS note FROM q LEFT JOIN (SELECT query_id, sum(selected::INT) AS s FROM dec GROUP BY query_id) USING (query_id)""",
        "recommend_both_limits": RECOMMEND + _both_limits(),
        "maxflow_edges": _GRAPH + " SELECT * FROM edges",
        "maxflow_small": _GRAPH + _MIN_CUT,
        "corpus_search": _with(QUERIES, INTENT, SYNONYMS, TEXTS, VOCAB, TERMS, SCORED) + f"SELECT {q}, rank, corpus_pos, product_name, rec_category, brand, score, total_matches FROM ranked WHERE rank <= 10",
        "parse_cases": _parse_cases(),
        "maxflow_paths": f"SELECT graph_id, max_flow, 4::BIGINT AS shortest, true AS ordered, true AS ends, true AS kept FROM ({_GRAPH + _MIN_CUT})",
        "maxflow_demo": _with(_rows("e", "edge_pos, src, dst, c", [(i, *e) for i, e in enumerate(data.DEMO)]) + ", edges AS (SELECT r_name AS graph_id, src, dst, c + (edge_pos + r_regionkey) % 3 AS capacity FROM e, region)") + """SELECT graph_id, min(cut)::BIGINT AS max_flow FROM (
            SELECT graph_id, x, sum(CASE WHEN (src = 0 OR (x >> (src - 1)) & 1 = 1) AND NOT (dst < 7 AND (x >> (dst - 1)) & 1 = 1) THEN capacity ELSE 0 END) AS cut
            FROM edges CROSS JOIN (SELECT unnest(range(0, 64)) AS x) GROUP BY graph_id, x) GROUP BY graph_id""",
        "maxflow_rounds": """WITH asked AS (SELECT c_nationkey AS k, count(*) AS a FROM customer GROUP BY c_nationkey),
            lines AS (SELECT l_partkey, min(l_suppkey) AS s, count(*) AS n FROM lineitem GROUP BY l_partkey),
            parts AS (SELECT s, p_type, least(n % 5 + 1, p_size % 4 + 1) AS m FROM part JOIN lines ON l_partkey = p_partkey),
            types AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS i, floor(count(*) * (length(p_type) % 3 + 1) / 4)::BIGINT AS t FROM parts GROUP BY p_type),
            sides AS (SELECT unnest(range(0, (1 << (SELECT count(*) FROM types))::BIGINT)) AS x),
            by_supplier AS (SELECT x, s, sum(m) AS m FROM parts JOIN types USING (p_type), sides WHERE (x >> i) & 1 = 1 GROUP BY x, s),
            by_nation AS (SELECT x, s_nationkey AS k, sum(least(m, s_suppkey * 37 % 29 + 1)) AS m FROM by_supplier JOIN supplier ON s_suppkey = s GROUP BY x, s_nationkey),
            above AS (SELECT x, sum(least(m, a)) AS cut FROM by_nation JOIN asked USING (k) GROUP BY x),
            below AS (SELECT x, coalesce(sum(t) FILTER ((x >> i) & 1 = 0), 0) AS cut FROM sides, types GROUP BY x)
            SELECT 'supply' AS graph_id, min(coalesce(above.cut, 0) + below.cut)::BIGINT AS max_flow FROM below LEFT JOIN above USING (x)""",
        "recommend_names_only": _with("bare AS (SELECT * FROM (SELECT p_size AS query_id, row_number() OVER (PARTITION BY p_size ORDER BY id) AS rank, CASE WHEN trim(end0) = '' THEN '' ELSE end0 || ' ' || p_name END AS product_name, kind0 AS category FROM " + _turns(end=[n for _, _, n, _ in data.BARE], kind=[c for _, _, _, c in data.BARE]) + ") WHERE rank <= 30)") + """, named AS (
            SELECT query_id, rank, trim(product_name) AS product_name, CASE WHEN trim(coalesce(category, '')) = '' THEN 'Other Products' ELSE trim(category) END AS category FROM bare WHERE trim(product_name) <> ''),
            once AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY query_id, lower(product_name) ORDER BY rank) = 1)
            SELECT query_id::BIGINT AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS slot, rank::BIGINT AS rank, product_name, category, '-' AS brand, '-' AS score, 1::BIGINT AS tier
            FROM once QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 6""".replace(", named AS", "SELECT * FROM (WITH named AS", 1) + ")",
        "maxflow_tier_network": RECOMMEND + f"SELECT {q}, least(6, sum(least(2, c)))::BIGINT AS max_flow FROM (SELECT query_id, brand_key, count(*) AS c FROM labelled GROUP BY query_id, brand_key) GROUP BY query_id",
    }
    return out


STRIP = data.STRIP_CASES
