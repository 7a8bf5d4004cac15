"""DuckDB statements that recompute the registered queries from the given tables."""

from __future__ import annotations

from pagesift.plans.inputs import KEYWORDS, NGRAM_RULES, RULES, SINGLE_RULES

_CTES: dict[str, tuple[list[str], str]] = {}


def _cte(name: str, needs: list[str], body: str) -> None:
    _CTES[name] = (needs, body)


def _with(needs: list[str], body: str) -> str:
    """`body` with the named tables, and those they need, in front of it."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in _CTES[name][0]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({_CTES[n][1]})" for n in ordered)
    return f"WITH {parts}\n{body}" if parts else body


_NUMBER = (
    "^(?:(?:0|x)?(?:0|[1-9a-f][0-9a-f]{0,3})|0(?:[1-7][0-7]{0,4}|1[0-7]{5}))$"
)

_cte(
    "samples",
    [],
    """
SELECT page_id AS sample_id, url AS path, CASE page_id % 9
 WHEN 0 THEN html WHEN 1 THEN nodt WHEN 2 THEN nos WHEN 3 THEN noh
 WHEN 4 THEN regexp_replace(noh, '</?body>', '', 'gis')
 WHEN 5 THEN regexp_replace(html, '</?html[^>]*>', '', 'gis')
 WHEN 6 THEN sc WHEN 7 THEN regexp_replace(sc, '</?script>', '', 'gis')
 ELSE concat('x="', html) END AS content
FROM (SELECT *, regexp_replace(nos, '<head>.*</head>', '', 'gis') AS noh FROM (
 SELECT *, regexp_replace(nodt, '<script.*?</script>', '', 'gis') AS nos FROM (
 SELECT *, regexp_replace(html, '<!doctype html>', '', 'gis') AS nodt,
  regexp_extract(html, '<script>.*?</script>', 0, 's') AS sc FROM pages)))""",
)
_cte(
    "page_texts",
    [],
    "SELECT page_id AS sample_id, url AS path, html AS content FROM pages",
)
_cte(
    "triaged",
    ["samples"],
    r"""
SELECT sample_id, path, content, (CASE
 WHEN regexp_matches(content, '(?:^|[^"''/])<!doctype html', 'i') THEN
  CASE WHEN regexp_matches(content, '(?:^|[^"''/])<html.*?>', 'i') THEN 12 ELSE 1 END
 WHEN regexp_matches(content, '(?:^|[^"''/])<html.*?>', 'i') THEN
  CASE WHEN regexp_matches(content, '<script.*>.*</script>', 'is') THEN 22
       WHEN regexp_matches(content, '<head.*>.*</head>', 'is') THEN 23
       WHEN regexp_matches(content, '<body.*>.*</body>', 'is') THEN 24 ELSE 2 END
 WHEN regexp_matches(content, '^[ \t\n\x0B\f\r]*<script.*?>.+</script>', 'is') THEN 3
 ELSE 0 END)::INTEGER AS code FROM samples""",
)
_cte(
    "type_table",
    ["samples"],
    """
SELECT sha1(content) AS sha1, CASE sample_id % 4 WHEN 0 THEN 'HTML' WHEN 1 THEN ''
 ELSE 'JavaScript' END AS file_type FROM samples WHERE sample_id % 4 <> 3
UNION ALL SELECT sha1(content), 'Text' FROM samples WHERE sample_id % 20 = 4""",
)
_ROUTE = """CASE {code} WHEN 3 THEN 'html/script' WHEN 22 THEN 'html/html_script'
 WHEN 23 THEN 'html/html_head' WHEN 24 THEN 'html/html_body' WHEN 12 THEN 'html/doctype_html'
 WHEN 1 THEN 'html/doctype' WHEN 2 THEN 'lookup' WHEN 0 THEN 'no_html/no_match_by_re' END"""
_cte(
    "routed",
    ["triaged", "type_table"],
    f"""
SELECT DISTINCT t.sample_id, t.path, t.content, CASE
 WHEN t.code <> 2 THEN {_ROUTE.format(code='t.code')}
 WHEN y.sha1 IS NULL THEN 'uncertain/no_file' WHEN y.file_type = '' THEN 'uncertain/no_type'
 WHEN y.file_type = 'HTML' THEN 'html/judge_by_vt' ELSE 'no_html/judge_by_vt' END AS route
FROM triaged t LEFT JOIN type_table y ON t.code = 2 AND sha1(t.content) = y.sha1""",
)
_cte(
    "scored",
    [],
    """
SELECT d.doc_id AS sample_id, l.quality AS label, d.source AS set_name,
 (('0x' || substr(md5(d.doc_id::VARCHAR), 1, 8))::BIGINT % 700 + 300 * l.quality)
  / 1000.0::DOUBLE AS score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
_cte(
    "encoded",
    ["page_texts"],
    r"""
SELECT sample_id, (CASE sample_id % 3 WHEN 0 THEN '' WHEN 1 THEN '0D0A09' ELSE '735C0A' END) ||
 CASE sample_id % 5 WHEN 0 THEN h WHEN 1 THEN regexp_replace(h, '(..)', '00\1', 'g')
 WHEN 2 THEN regexp_replace(h, '(..)', '\100', 'g')
 WHEN 3 THEN regexp_replace(h, '(..)', '000000\1', 'g')
 ELSE regexp_replace(h, '(..)', '\1000000', 'g') END AS hexbytes
FROM (SELECT sample_id, hex(regexp_replace(content, '[^\x00-\x7F]', '', 'g')) AS h FROM page_texts)""",
)
_cte(
    "detected",
    ["encoded"],
    r"""
SELECT sample_id, rest, CASE WHEN regexp_matches(head, '^(?:000000..){3}000000')
  THEN 'ENCODE_UTF_32_BE'
 WHEN regexp_matches(head, '^(?:..000000){4}') THEN 'ENCODE_UTF_32_LE'
 WHEN regexp_matches(head, '^(?:00..){3}00') THEN 'ENCODE_UTF_16_BE'
 WHEN regexp_matches(head, '^(?:..00){4}') THEN 'ENCODE_UTF_16_LE'
 ELSE 'ENCODE_UNKNOWN' END AS encoding
FROM (SELECT sample_id, regexp_replace(substr(hexbytes, 1, 1000), '^(?:5C|73|09|0D|0A)+', '') AS head,
  regexp_replace(hexbytes, '^(?:5C|73|09|0D|0A)+', '') AS rest FROM encoded)""",
)
_cte(
    "corpus",
    ["page_texts"],
    """
SELECT sample_id, 1::INTEGER AS label, path, content FROM page_texts
UNION ALL SELECT 1000000000 + doc_id, 0, 'documents/' || doc_id::VARCHAR, text FROM documents""",
)
_cte(
    "feature_lines",
    ["page_texts"],
    """
SELECT sample_id, (sample_id % 2)::VARCHAR || ' 0:1 ' || (3 + sample_id % 5)::VARCHAR || ':1  # /data/s/'
 || sample_id::VARCHAR || CASE WHEN sample_id % 3 = 0 THEN '@scored' ELSE '' END AS line
FROM page_texts""",
)
_cte(
    "labelled_paths",
    [],
    """
SELECT d.doc_id AS sample_id, l.toxic, d.source,
 (CASE WHEN l.toxic = 1 THEN 'validation/mal_set/malicious-' ELSE 'validation/nor_set/normal-' END)
 || d.source || (CASE WHEN l.quality = 0 THEN '/malicious' ELSE '' END) || '/' || d.doc_id::VARCHAR
 AS path FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)

# words of the corpus
_cte(
    "ascii_words",
    ["corpus"],
    r"""
SELECT sample_id, label, path, regexp_extract_all(
 regexp_replace(strip_accents(lower(content)), '[^\x00-\x7F]', '', 'g'), '[a-z0-9_]{2,}') AS w
FROM corpus""",
)
_cte(
    "words",
    ["ascii_words"],
    f"""
SELECT sample_id, label, path, list_filter(w, lambda x: NOT regexp_matches(x, '{_NUMBER}')) AS w
FROM ascii_words""",
)
_UNI = "w"
_BI = "[w[i] || ' ' || w[i+1] for i in range(1, len(w))]"
_TRI = "[w[i] || ' ' || w[i+1] || ' ' || w[i+2] for i in range(1, len(w) - 1)]"
_cte("terms1", ["words"], f"SELECT sample_id, unnest({_UNI}) AS term FROM words")
_cte(
    "terms12",
    ["words"],
    f"SELECT sample_id, unnest(list_concat({_UNI}, {_BI})) AS term FROM words",
)
_cte(
    "terms23",
    ["words"],
    f"SELECT sample_id, unnest(list_concat({_BI}, {_TRI})) AS term FROM words",
)
_cte(
    "counts23",
    ["terms23"],
    "SELECT sample_id, term, count(*) AS tf FROM terms23 GROUP BY ALL",
)
_cte(
    "top23",
    ["counts23"],
    """
SELECT term, sum(tf)::BIGINT AS ctf, count(*) AS df FROM counts23 GROUP BY term
ORDER BY ctf DESC, term LIMIT 300""",
)
_cte(
    "vocabulary23",
    ["top23"],
    "SELECT (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx, term, ctf, df FROM top23",
)
_cte(
    "weights23",
    ["counts23", "vocabulary23"],
    """
SELECT sample_id, idx, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY sample_id)) AS value
FROM (SELECT c.sample_id, v.idx, v.term,
 c.tf * (ln((1 + (SELECT count(*) FROM corpus)) / (1 + v.df)) + 1) AS raw
 FROM counts23 c JOIN vocabulary23 v ON c.term = v.term)""",
)
_cte(
    "frequent1",
    ["terms1"],
    """
SELECT (row_number() OVER (ORDER BY ctf DESC, term) - 1)::INTEGER AS idx, term AS keyword FROM (
 SELECT term, count(*) AS ctf FROM terms1 GROUP BY term ORDER BY ctf DESC, term LIMIT 100)""",
)
_cte(
    "frequent23",
    ["counts23"],
    """
SELECT (row_number() OVER (ORDER BY ctf DESC, term) - 1)::INTEGER AS idx, term AS keyword FROM (
 SELECT term, sum(tf) AS ctf FROM counts23 GROUP BY term ORDER BY ctf DESC, term LIMIT 100)""",
)

# presence: one constant pattern per keyword, the first index of a repeated keyword
_KEYWORD = "(?:^|[^\\p{{L}}\\p{{N}}_]){}(?:$|[^\\p{{L}}\\p{{N}}_])"
_RULE = "(?:^|[^a-z0-9]){}(?:$|[^a-z0-9])"


def _presence(source: str, pattern: str, rows: list[tuple[int, str]]) -> str:
    first: dict[str, int] = {}
    for idx, keyword in rows:
        first.setdefault(keyword, idx)
    return " UNION ALL ".join(
        f"SELECT sample_id, {idx}::INTEGER AS idx, 1.0::DOUBLE AS value FROM {source} "
        f"WHERE regexp_matches(lower(content), '{pattern.format(keyword)}')"
        for keyword, idx in first.items()
    )


_cte("keyword_hits", ["page_texts"], _presence("page_texts", _KEYWORD, KEYWORDS))
_cte("single_hits", ["page_texts"], _presence("page_texts", _RULE, SINGLE_RULES))
_cte("rule_hits", ["page_texts"], _presence("page_texts", _RULE, RULES))
_cte("sample_rule_hits", ["samples"], _presence("samples", _RULE, RULES))
_cte("corpus_keyword_hits", ["corpus"], _presence("corpus", _KEYWORD, KEYWORDS))
_cte("corpus_rule_hits", ["corpus"], _presence("corpus", _RULE, SINGLE_RULES + NGRAM_RULES))


def _ones(source: str, hits: str, label: str, comment: str) -> str:
    """Feature lines whose values are all 1."""
    return f"""
SELECT s.sample_id, {label} || ' ' || coalesce(h.pairs, '') || ' # ' || {comment} AS line
FROM {source} s LEFT JOIN (SELECT sample_id, string_agg(idx::VARCHAR || ':1 ', '' ORDER BY idx)
 AS pairs FROM {hits} GROUP BY sample_id) h ON s.sample_id = h.sample_id"""


# hashing: words of any script, no stop words
_cte(
    "unicode_terms",
    ["corpus"],
    f"""
SELECT sample_id, unnest(list_concat(w, {_BI}, {_TRI})) AS term FROM (
 SELECT sample_id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM corpus)""",
)
_cte(
    "hashed",
    ["unicode_terms"],
    """
SELECT sample_id, idx, total / sqrt(sum(total * total) OVER (PARTITION BY sample_id)) AS value FROM (
 SELECT sample_id, (('0x' || substr(digest, 1, 8))::BIGINT % 100)::INTEGER AS idx,
  sum(CASE WHEN substr(digest, 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS total
 FROM (SELECT sample_id, md5(term) AS digest FROM unicode_terms) GROUP BY ALL) WHERE total <> 0""",
)

# digest
_cte(
    "ascii_texts",
    ["corpus"],
    r"""
SELECT sample_id, t, len(t) AS n, list_transform(string_split(t, ''), lambda x: ascii(x)) AS a FROM (
 SELECT sample_id, regexp_replace(content, '[^\x00-\x7F]', '', 'g') AS t FROM corpus)
WHERE len(t) >= 50""",
)
_cte(
    "buckets",
    ["ascii_texts"],
    """
SELECT sample_id, (p * 961 + q * 31 + r + 7 * k) % 128 AS bucket, count(*) AS n FROM (
 SELECT sample_id, z[1] AS p, unnest([z[2], z[2], z[2], z[3], z[3], z[4]]) AS q,
  unnest([z[3], z[4], z[5], z[4], z[5], z[5]]) AS r, unnest([0, 1, 2, 3, 4, 5]) AS k
 FROM (SELECT sample_id, unnest([[a[i], a[i+1], a[i+2], a[i+3], a[i+4]]
  for i in range(1, len(a) - 3)]) AS z FROM ascii_texts)) GROUP BY ALL""",
)
_cte(
    "bucket_codes",
    ["buckets"],
    """
SELECT sample_id, bucket, CASE WHEN n <= q1 THEN 0 WHEN n <= q2 THEN 1 WHEN n <= q3 THEN 2 ELSE 3 END
 AS code, q1, q2, q3 FROM (
 SELECT *, s[32] AS q1, s[64] AS q2, s[96] AS q3 FROM (
  SELECT sample_id, bucket, n, list(n) OVER (PARTITION BY sample_id ORDER BY n
   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM (
   SELECT g.sample_id, g.bucket, coalesce(b.n, 0) AS n FROM (
    SELECT sample_id, unnest(range(128)) AS bucket FROM ascii_texts) g
   LEFT JOIN buckets b ON g.sample_id = b.sample_id AND g.bucket = b.bucket)))""",
)
_cte(
    "nibbles",
    ["bucket_codes", "ascii_texts"],
    """
SELECT sample_id, (bucket // 2)::INTEGER AS idx,
 sum(CASE WHEN bucket % 2 = 0 THEN 4 * code ELSE code END)::DOUBLE AS value
FROM bucket_codes GROUP BY sample_id, bucket // 2
UNION ALL SELECT sample_id, 64, ((n % 256) // 16)::DOUBLE FROM ascii_texts
UNION ALL SELECT sample_id, 65, ((n % 256) % 16)::DOUBLE FROM ascii_texts
UNION ALL SELECT sample_id, 66, CASE WHEN q3 = 0 THEN 0 ELSE ((100 * q1) // q3) % 16 END::DOUBLE
 FROM bucket_codes WHERE bucket = 0
UNION ALL SELECT sample_id, 67, CASE WHEN q3 = 0 THEN 0 ELSE ((100 * q2) // q3) % 16 END::DOUBLE
 FROM bucket_codes WHERE bucket = 0""",
)

# dictionary
_cte(
    "dictionary",
    ["corpus"],
    r"""
SELECT token, row_number() OVER (ORDER BY first, token) - 1 AS id FROM (
 SELECT token, min(sample_id) AS first FROM (
  SELECT sample_id, unnest(regexp_split_to_array(content, '[ \t\n\x0B\f\r]+')) AS token FROM corpus)
 WHERE token <> '' GROUP BY token)""",
)

# metrics
_cte(
    "parts",
    ["corpus"],
    """
SELECT sample_id, label, CASE WHEN ('0x' || substr(md5(sample_id::VARCHAR), 1, 8))::BIGINT % 10000
 < 7000 THEN 'a' ELSE 'b' END AS part FROM corpus""",
)


def _metrics(group: str) -> str:
    """Metrics per group; AUC by counting pairs."""
    first = f"{group}, " if group else ""
    join = f"ON a.{group} = b.{group}" if group else "ON true"
    by = f"GROUP BY {group}" if group else ""
    pair_by = f"GROUP BY p.{group}" if group else ""
    pair_first = f"p.{group}, " if group else ""
    same = f"AND p.{group} = n.{group}" if group else ""
    return f"""
SELECT {f'b.{group}, ' if group else ''}tp, tn, fp, fn,
 round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(p, 6) AS precision,
 round(r, 6) AS recall, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END, 6) AS fpr,
 round(1 - p, 6) AS fdr,
 round(CASE WHEN 2 * tp + fp + fn = 0 THEN NULL ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
 round(CASE WHEN 4 * p + r = 0 THEN NULL ELSE 5 * p * r / (4 * p + r) END, 6) AS f2,
 round(a.auc, 6) AS auc
FROM (SELECT *, (CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END)::DOUBLE AS p,
  (CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END)::DOUBLE AS r FROM (
 SELECT {first}count(*) FILTER (score >= 0.5 AND label = 1) AS tp,
  count(*) FILTER (score < 0.5 AND label = 0) AS tn,
  count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
  count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM scored {by})) b
LEFT JOIN (SELECT {pair_first}sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score
  THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS auc
 FROM scored p JOIN scored n ON p.label = 1 AND n.label = 0 {same} {pair_by}) a {join}"""


_BUCKET = "CASE " + " ".join(
    f"WHEN score >= {low / 10} THEN '{low}_{low + 1}'" for low in range(9, 0, -1)
) + " ELSE '0_1' END"

_PATH = "trim(list_extract(string_split(string_split(line, '@')[1], '#'), -1))"

ORACLES: dict[str, str] = {
    "scan_samples": _with(
        ["page_texts"],
        "SELECT sample_id, path, list_extract(string_split(path, '/'), -1) AS name, "
        "sha1(content) AS sha1 FROM page_texts",
    ),
    "scan_sample_files": (
        "SELECT printf('%012d', doc_id) AS name, sha1(coalesce(text, '')) AS sha1, "
        "strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents WHERE doc_id IS NOT NULL"
    ),
    "labelled_corpus": _with(
        ["page_texts"],
        "SELECT sample_id, 1::INTEGER AS label, length(content)::INTEGER AS chars FROM page_texts "
        "UNION ALL SELECT doc_id, 0, length(text)::INTEGER FROM documents",
    ),
    "list_sample_names": "SELECT list_extract(string_split(url, '/'), -1) AS name FROM pages",
    "corpus_manifest": (
        "SELECT url AS path FROM pages UNION ALL SELECT 'documents/' || doc_id::VARCHAR FROM documents"
    ),
    "scan_type_table": _with(["type_table"], "SELECT sha1, file_type FROM type_table"),
    "load_keywords": r"""
SELECT min(position) AS idx, keyword FROM (
 SELECT doc_id * 1000000000 + i - 1 AS position, w[i] AS keyword FROM (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (
   SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
   FROM documents))) GROUP BY keyword""",
    "load_keyword_rules": _with(
        ["frequent1"], "SELECT idx, keyword, true AS fullword, true AS nocase FROM frequent1"
    ),
    "merge_rule_sets": _with(
        ["frequent1", "frequent23"],
        "SELECT idx, keyword, true AS fullword, true AS nocase FROM frequent1 "
        "UNION ALL SELECT idx + 820, keyword, true, true FROM frequent23",
    ),
    "read_libsvm": """
SELECT (sample_id % 2)::INTEGER AS label, '/data/s/' || sample_id::VARCHAR ||
  CASE WHEN sample_id % 3 = 0 THEN '@scored' ELSE '' END AS comment, idx::INTEGER AS idx,
 1.0::DOUBLE AS value
FROM (SELECT page_id AS sample_id, unnest([0, 3 + page_id % 5]) AS idx FROM pages)""",
    "write_libsvm": _with(
        ["page_texts", "keyword_hits"],
        f"SELECT line FROM ({_ones('page_texts', 'keyword_hits', chr(39) + '1' + chr(39), 's.path')})",
    ),
    "dump_matrix_libsvm": _with(
        ["corpus", "weights23"],
        """
SELECT c.label, c.label::VARCHAR || ' ' || coalesce(h.pairs, '') ||
 CASE WHEN c.label = 1 THEN ' # ' || c.path ELSE '' END AS line
FROM corpus c LEFT JOIN (SELECT sample_id, string_agg(idx::VARCHAR || ':' ||
  CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE printf('%.6f', v) END || ' ', '' ORDER BY idx)
  AS pairs FROM (SELECT *, round(value, 6) AS v FROM weights23) GROUP BY sample_id) h
 ON c.sample_id = h.sample_id""",
    ),
    "dump_matrix_dense": _with(
        ["corpus", "vocabulary23", "weights23"],
        """
SELECT c.sample_id, string_agg(printf('%.6f', coalesce(round(w.value, 6), 0.0)), ' ' ORDER BY v.idx)
 AS line FROM corpus c CROSS JOIN vocabulary23 v
LEFT JOIN weights23 w ON c.sample_id = w.sample_id AND v.idx = w.idx GROUP BY c.sample_id""",
    ),
    "dump_vocabulary": _with(["vocabulary23"], "SELECT term FROM vocabulary23"),
    "route_samples": _with(
        ["routed"], "SELECT sample_id, length(content)::INTEGER AS chars, route FROM routed"
    ),
    "route_by_score": _with(
        ["scored"], f"SELECT {_BUCKET} AS bucket, count(*) AS samples FROM scored GROUP BY ALL"
    ),
    "misclassified_rows": _with(
        ["scored"],
        "SELECT sample_id, label, score, 'hashed' AS model, "
        "CASE WHEN label = 1 THEN 'fn' ELSE 'fp' END AS outcome "
        "FROM scored WHERE (score >= 0.5) <> (label = 1)",
    ),
    "validation_sets": _with(
        ["labelled_paths"],
        "SELECT sample_id, CASE WHEN toxic = 1 THEN 'malicious-' ELSE 'normal-' END || source "
        "AS set_name, toxic::INTEGER AS label FROM labelled_paths",
    ),
    "strip_leading": _with(
        ["detected"], "SELECT sample_id, sha1(unhex(rest)) AS sha1 FROM detected"
    ),
    "detect_encoding": _with(["detected"], "SELECT sample_id, encoding FROM detected"),
    "narrow_encoding": _with(
        ["detected"],
        r"""
SELECT sample_id, sha1(unhex(CASE encoding
 WHEN 'ENCODE_UTF_32_BE' THEN regexp_replace(rest, '(?:..){3}(..)|(?:..){1,3}$', '\1', 'g')
 WHEN 'ENCODE_UTF_32_LE' THEN regexp_replace(rest, '(..)(?:..){0,3}', '\1', 'g')
 WHEN 'ENCODE_UTF_16_BE' THEN regexp_replace(rest, '..(..)|..$', '\1', 'g')
 WHEN 'ENCODE_UTF_16_LE' THEN regexp_replace(rest, '(..)(?:..)?', '\1', 'g')
 ELSE rest END)) AS sha1 FROM detected""",
    ),
    "triage_code": _with(["triaged"], "SELECT sample_id, code FROM triaged"),
    "triage_route": _with(
        ["triaged"], f"SELECT sample_id, {_ROUTE.format(code='code')} AS route FROM triaged"
    ),
    "label_from_path": _with(
        ["labelled_paths"],
        "SELECT sample_id, CASE WHEN len(regexp_extract_all(path, 'normal')) < "
        "len(regexp_extract_all(path, 'malicious')) THEN 1 ELSE 0 END::INTEGER AS label "
        "FROM labelled_paths",
    ),
    "path_from_line": _with(["feature_lines"], f"SELECT {_PATH} AS path FROM feature_lines"),
    "positive_only": _with(
        ["corpus", "hashed"],
        "SELECT c.sample_id, count(h.idx)::INTEGER AS entries, "
        "count(*) FILTER (h.value > 0)::INTEGER AS positive "
        "FROM corpus c LEFT JOIN hashed h ON c.sample_id = h.sample_id GROUP BY c.sample_id",
    ),
    "stop_number_tokens": _with(
        ["ascii_words"],
        f"SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM ascii_words) "
        f"WHERE regexp_matches(word, '{_NUMBER}') GROUP BY word",
    ),
    "binarise": _with(
        ["weights23"],
        "SELECT sample_id, idx, CASE WHEN value > 0 THEN 1 ELSE 0 END::DOUBLE AS value FROM weights23",
    ),
    "select_columns": _with(
        ["weights23", "vocabulary23"],
        "SELECT w.sample_id, w.idx, round(w.value, 6) AS value FROM weights23 w WHERE w.idx IN "
        "(SELECT idx FROM vocabulary23 ORDER BY df DESC, term LIMIT 100)",
    ),
    "rebase_index": _with(
        ["weights23"],
        "SELECT sample_id, (idx + 820)::INTEGER AS idx, round(value, 6) AS value FROM weights23",
    ),
    "decide": _with(
        ["scored"],
        "SELECT sample_id, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END::INTEGER AS decision FROM scored",
    ),
    "score_bucket": _with(["scored"], f"SELECT sample_id, {_BUCKET} AS bucket FROM scored"),
    "digest_nibbles": _with(
        ["page_texts"],
        """
SELECT sample_id, (i - 1)::INTEGER AS idx,
 (instr('0123456789abcdef', substr(d, i, 1)) - 1)::DOUBLE AS value
FROM (SELECT sample_id, sha1(content) AS d, unnest(range(1, 41)) AS i FROM page_texts)""",
    ),
    "unlabelled_features": _with(
        ["routed", "sample_rule_hits"],
        _ones(
            "(SELECT * FROM routed WHERE route LIKE 'uncertain/%')", "sample_rule_hits", "'0'", "s.path"
        ),
    ),
    "type_lookup": _with(["routed"], "SELECT sample_id, route FROM routed"),
    "keyword_presence": _with(["keyword_hits"], "SELECT * FROM keyword_hits"),
    "rule_presence": _with(["single_hits"], "SELECT * FROM single_hits"),
    "ngram_rule_presence": _with(["rule_hits"], "SELECT * FROM rule_hits"),
    "features_for_samples": _with(
        ["feature_lines", "triaged"],
        f"SELECT line FROM feature_lines WHERE {_PATH} IN "
        "(SELECT '/data/s/' || sample_id::VARCHAR FROM triaged WHERE code IN (0, 2)) ",
    ),
    "dedupe_against": _with(
        ["triaged"],
        """
SELECT sample_id, path, CASE WHEN list_extract(string_split(path, '/'), -1) IN (
 SELECT list_extract(string_split(path, '/'), -1) FROM triaged WHERE code IN (12, 22))
 THEN 'removed' ELSE 'kept' END AS state FROM triaged""",
    ),
    "merge_features": _with(
        ["keyword_hits", "rule_hits"],
        """
SELECT coalesce(k.sample_id, r.sample_id) AS sample_id, coalesce(k.idx, r.idx) AS idx,
 CASE WHEN r.idx IS NULL THEN 1.0 ELSE 2.0 END::DOUBLE AS value
FROM keyword_hits k FULL JOIN rule_hits r ON k.sample_id = r.sample_id AND k.idx = r.idx""",
    ),
    "attach_scores": _with(
        ["scored"],
        "SELECT d.doc_id AS sample_id, d.lang, s.score FROM documents d LEFT JOIN scored s "
        "ON d.doc_id = s.sample_id",
    ),
    "restrict_to_vocabulary": _with(
        ["counts23", "vocabulary23"],
        "SELECT c.sample_id, c.tf::INTEGER AS tf, v.idx FROM counts23 c JOIN vocabulary23 v "
        "ON c.term = v.term",
    ),
    "class_counts": _with(
        ["corpus"],
        "SELECT count(*) FILTER (label = 1) AS html, count(*) FILTER (label = 0) AS no_html, "
        "count(*) AS total FROM corpus",
    ),
    "prior_threshold": _with(["corpus"], "SELECT round(avg(label), 6) AS threshold FROM corpus"),
    "distinct_names": (
        "SELECT count(DISTINCT list_extract(string_split(url, '/'), -1)) AS names FROM pages"
    ),
    "term_frequency": _with(
        ["terms1"],
        "SELECT sample_id, term, count(*)::INTEGER AS tf FROM terms1 GROUP BY ALL",
    ),
    "document_frequency": _with(
        ["terms12"],
        "SELECT term, count(*) AS ctf, count(DISTINCT sample_id) AS df FROM terms12 GROUP BY term",
    ),
    "tfidf": _with(
        ["weights23"], "SELECT sample_id, term, round(value, 6) AS value FROM weights23"
    ),
    "confusion": _with(
        ["scored"],
        """
SELECT set_name, count(*) FILTER (score >= 0.5 AND label = 1) AS tp,
 count(*) FILTER (score < 0.5 AND label = 0) AS tn,
 count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
 count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM scored GROUP BY set_name""",
    ),
    "metrics": _with(["scored"], _metrics("")),
    "auc": _with(["scored"], f"SELECT set_name, auc FROM ({_metrics('set_name')})"),
    "validation_metrics": _with(["scored"], _metrics("set_name")),
    "build_dictionary": _with(["dictionary"], "SELECT token, id FROM dictionary"),
    "doc_bow": _with(
        ["dictionary"],
        r"""
SELECT t.sample_id, d.id, count(*)::INTEGER AS n FROM (
 SELECT doc_id AS sample_id, unnest(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+')) AS token
 FROM documents) t JOIN dictionary d ON t.token = d.token GROUP BY ALL""",
    ),
    "script_count": _with(
        ["triaged"], "SELECT count(*) FILTER (code = 3) AS script_count FROM triaged"
    ),
    "triage_summary": _with(
        ["routed"], "SELECT route, count(*) AS samples FROM routed GROUP BY route"
    ),
    "top_terms": _with(["top23"], "SELECT term, ctf FROM top23"),
    "vocabulary_index": _with(["vocabulary23"], "SELECT idx, term FROM vocabulary23"),
    "ordered_features": _with(
        ["page_texts", "keyword_hits"],
        """
SELECT s.sample_id, coalesce(h.pairs, '') AS pairs FROM page_texts s LEFT JOIN (
 SELECT sample_id, string_agg(idx::VARCHAR || ':1', ' ' ORDER BY idx) AS pairs
 FROM keyword_hits GROUP BY sample_id) h ON s.sample_id = h.sample_id""",
    ),
    "split_by_rate": _with(["parts"], "SELECT sample_id, label, part FROM parts"),
    "train_test_sets": _with(
        ["parts"],
        "SELECT sample_id, label, CASE part WHEN 'a' THEN 'train' ELSE 'test' END AS set_name "
        "FROM parts",
    ),
    "full_refit_set": _with(["corpus"], "SELECT sample_id, label FROM corpus"),
    "keyword_features": _with(
        ["corpus", "corpus_keyword_hits"],
        _ones("corpus", "corpus_keyword_hits", "s.label::VARCHAR", "s.path"),
    ),
    "trigram_features": _with(
        ["corpus", "corpus_rule_hits"],
        _ones("corpus", "corpus_rule_hits", "s.label::VARCHAR", "s.path"),
    ),
    "hashing_features": _with(
        ["hashed"], "SELECT sample_id, idx, round(value, 6) AS value FROM hashed WHERE value > 0"
    ),
    "digest_features": _with(
        ["nibbles"], "SELECT sample_id, idx, value FROM nibbles WHERE value > 0"
    ),
}

# The stripped, narrowed content is the front bytes that are not white space, then the ASCII text.
# 's' and '\' are not white space, so they stay and the wide forms behind them are not aligned.
_cte(
    "narrowed",
    ["encoded"],
    r"""
SELECT sample_id, unhex(CASE
 WHEN regexp_matches(head, '^(?:000000..){3}000000')
  THEN regexp_replace(rest, '(?:..){3}(..)|(?:..){1,3}$', '\1', 'g')
 WHEN regexp_matches(head, '^(?:..000000){4}') THEN regexp_replace(rest, '(..)(?:..){0,3}', '\1', 'g')
 WHEN regexp_matches(head, '^(?:00..){3}00') THEN regexp_replace(rest, '..(..)|..$', '\1', 'g')
 WHEN regexp_matches(head, '^(?:..00){4}') THEN regexp_replace(rest, '(..)(?:..)?', '\1', 'g')
 ELSE rest END)::VARCHAR AS shown
FROM (SELECT sample_id, regexp_replace(substr(hexbytes, 1, 1000), '^(?:20|09|0D|0A|0C|0B)+', '') AS head,
 regexp_replace(hexbytes, '^(?:20|09|0D|0A|0C|0B)+', '') AS rest FROM encoded)""",
)
_cte(
    "narrowed_texts",
    ["narrowed"],
    # a BLOB prints its NUL bytes as \x00
    r"SELECT sample_id, replace(shown, '\x00', chr(1)) AS content FROM narrowed",
)
_cte("narrowed_hits", ["narrowed_texts"], _presence("narrowed_texts", _RULE, RULES))
ORACLES["rule_features"] = _with(
    ["narrowed_texts", "narrowed_hits"],
    _ones("narrowed_texts", "narrowed_hits", "'1'", "s.sample_id::VARCHAR"),
)

# What holds for every model and can be recomputed: completeness, totals and form of the output.
_FIRST = "least(100, (SELECT count(*) FROM vocabulary23))"
_SETS = """SELECT CASE part WHEN 'a' THEN 'train' ELSE 'test' END AS set_name,
 count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, true AS sound
FROM parts GROUP BY part"""
_TOPICS = f"""SELECT t::INTEGER AS topic, {_FIRST}::BIGINT AS terms, true AS in_order
FROM range(0, 2) r(t)"""
ORACLES |= {
    "importance_rank": _with(["vocabulary23"], "SELECT idx, term, true AS in_order FROM vocabulary23"),
    "select_features": _with(["vocabulary23"], "SELECT idx, true AS weighed FROM vocabulary23"),
    "top_features": _with(
        ["vocabulary23"],
        f"SELECT {_FIRST}::BIGINT AS features, {_FIRST}::INTEGER AS last_rank",
    ),
    "importance_report": _with(
        ["vocabulary23"], "SELECT idx, term, true AS ranked FROM vocabulary23"
    ),
    "generate_rules": _with(
        ["vocabulary23"],
        f"SELECT {_FIRST}::BIGINT AS rules, {_FIRST}::BIGINT AS in_vocabulary, "
        f"({_FIRST} - 1)::INTEGER AS last_idx, true AS bounded",
    ),
    "train_and_score": _with(["parts"], _SETS),
    "make_classifier": _with(
        ["corpus"],
        "SELECT m AS model, sample_id, true AS probability FROM corpus, "
        "(SELECT unnest(['svm', 'xgboost', 'keras']) AS m)",
    ),
    "model_metrics": _with(
        ["parts"],
        f"SELECT m AS model, positives, negatives, sound FROM ({_SETS}), "
        "(SELECT unnest(['svm', 'xgboost', 'keras']) AS m) WHERE set_name = 'test'",
    ),
    "scoring_time": "SELECT unnest(['svm', 'xgboost']) AS model, true AS timed",
    "score_samples": _with(["corpus"], "SELECT sample_id, true AS probability FROM corpus"),
    "save_model": _with(["corpus"], "SELECT sample_id, true AS same FROM corpus"),
    "load_model": _with(["corpus"], "SELECT sample_id, true AS probability FROM corpus"),
    "route_feature_file": _with(
        ["corpus"],
        "SELECT sample_id, true AS in_bucket FROM corpus WHERE "
        "('0x' || substr(md5(sample_id::VARCHAR), 1, 8))::BIGINT % 10000 >= 5000",
    ),
    "self_train_round": _with(
        ["corpus"],
        "SELECT count(*) AS samples, count(DISTINCT sample_id) AS distinct_samples, count(*) FILTER ("
        "('0x' || substr(md5(sample_id::VARCHAR), 1, 8))::BIGINT % 10000 < 5000) AS labelled_before "
        "FROM corpus",
    ),
    "doc_vectors": _with(
        ["corpus"], "SELECT sample_id, 300::INTEGER AS size, true AS complete FROM corpus"
    ),
    "doc_vector_features": _with(["corpus"], "SELECT label, path, true AS in_range FROM corpus"),
    "sweep_vector_size": _with(
        ["corpus"],
        """
SELECT s::INTEGER AS size, set_name, samples FROM (SELECT unnest([10, 20]) AS s), (
 SELECT 'train' AS set_name, count(*) AS samples FROM corpus UNION ALL
 SELECT d.source, count(*) FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source)""",
    ),
    "feature_sets": _with(
        ["corpus"],
        """
SELECT s::INTEGER AS size, set_name, label, path, true AS in_range FROM (SELECT unnest([10, 20]) AS s), (
 SELECT 'train' AS set_name, label, path FROM corpus UNION ALL
 SELECT d.source, l.toxic, '/data/d/' || d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    ),
    "lda_topics": _with(["vocabulary23"], _TOPICS),
    "nmf_topics": _with(["vocabulary23"], _TOPICS),
    "topic_top_words": "SELECT t::INTEGER AS topic, true AS complete FROM range(0, 2) r(t)",
}

_cte("corpus_single_hits", ["corpus"], _presence("corpus", _RULE, SINGLE_RULES))
_cte(
    "document_hits",
    ["corpus_single_hits", "weights23", "vocabulary23"],
    """
SELECT sample_id, idx FROM corpus_single_hits UNION ALL
SELECT sample_id, (820 + idx)::INTEGER FROM weights23
WHERE idx IN (SELECT idx FROM vocabulary23 ORDER BY df DESC, term LIMIT 100)""",
)
_cte(
    "unicode_words",
    ["corpus"],
    f"""
SELECT sample_id, label, list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
 lambda x: NOT regexp_matches(x, '{_NUMBER}')) AS w FROM corpus""",
)


def _grams13(name: str, words: str, count: int) -> None:
    """counts, vocabulary and ranks by documents of the most frequent (1,3)-grams."""
    _cte(
        f"counts{name}",
        [words],
        f"""
SELECT sample_id, term, count(*) AS tf FROM (
 SELECT sample_id, unnest(list_concat(w, {_BI}, {_TRI})) AS term FROM {words}) GROUP BY ALL""",
    )
    _cte(
        f"vocabulary{name}",
        [f"counts{name}"],
        f"""
SELECT *, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx,
 (row_number() OVER (ORDER BY df DESC, term) - 1)::INTEGER AS place FROM (
 SELECT term, sum(tf) AS ctf, count(*) AS df FROM counts{name} GROUP BY term
 ORDER BY ctf DESC, term LIMIT {count})""",
    )


_grams13("13", "words", 1000)
_grams13("13u", "unicode_words", 300)
_cte(
    "rank_hits",
    ["counts13u", "vocabulary13u"],
    "SELECT c.sample_id, (10 + v.place)::INTEGER AS idx FROM counts13u c JOIN vocabulary13u v "
    "ON c.term = v.term WHERE v.place < 100",
)
ORACLES |= {
    "keyword_tfidf_features_by_documents": _with(
        ["corpus", "document_hits"], _ones("corpus", "document_hits", "s.label::VARCHAR", "s.path")
    ),
    "tfidf_features_by_documents": _with(
        ["counts13", "vocabulary13", "corpus"],
        """
SELECT sample_id, idx, round(value, 6) AS value FROM (
 SELECT sample_id, idx, place, raw / sqrt(sum(raw * raw) OVER (PARTITION BY sample_id)) AS value FROM (
  SELECT c.sample_id, v.idx, v.place,
   c.tf * (ln((1 + (SELECT count(*) FROM corpus)) / (1 + v.df)) + 1) AS raw
  FROM counts13 c JOIN vocabulary13 v ON c.term = v.term)) WHERE place < 300""",
    ),
    "tfidf_rank_features_by_documents": _with(
        ["corpus", "rank_hits"],
        """
SELECT s.sample_id, s.label::VARCHAR || ' ' || coalesce(h.pairs, '') AS line FROM corpus s LEFT JOIN (
 SELECT sample_id, string_agg(idx::VARCHAR || ':1 ', '' ORDER BY idx) AS pairs FROM rank_hits
 GROUP BY sample_id) h ON s.sample_id = h.sample_id""",
    ),
}

ORACLES["rule_table_presence"] = """
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents),
t AS (SELECT DISTINCT page_id AS sample_id, unnest(regexp_extract_all(lower(html), '[a-z0-9]+')) AS word FROM pages)
SELECT DISTINCT sample_id, ('0x' || substr(md5(word), 1, 7))::INTEGER AS idx, 1.0::DOUBLE AS value
FROM t JOIN w USING (word)"""

ORACLES["tfidf_table"] = _with(
    ["counts23"],
    """
SELECT sample_id, idx, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY sample_id)), 6) AS value
FROM (SELECT c.sample_id, v.idx,
 c.tf * (ln((1 + (SELECT count(*) FROM corpus)) / (1 + v.df)) + 1) AS raw
 FROM counts23 c JOIN (
  SELECT (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx, term, df FROM (
   SELECT term, sum(tf)::BIGINT AS ctf, count(*) AS df FROM counts23 GROUP BY term
   ORDER BY ctf DESC, term LIMIT 150000)) v ON c.term = v.term)""",
)

for _name in ("keyword", "rules", "hashing", "vectors"):
    ORACLES[f"train_{_name}"] = _with(["parts"], _SETS)
# texts under fifty ASCII characters have no digest
ORACLES["train_digest"] = _with(
    ["parts", "corpus"],
    _SETS.replace(
        "FROM parts",
        "FROM parts WHERE sample_id IN (SELECT sample_id FROM corpus "
        "WHERE length(regexp_replace(content, '[^\\x00-\\x7F]+', '', 'g')) >= 50)",
    ),
)
ORACLES["refit_model"] = _with(["corpus"], "SELECT sample_id, true AS probability FROM corpus")
