"""DuckDB SQL that chat formatting, the manifest, the divergence audit, paragraphs and URL rules are held against."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Lengths only for what escaping adds: a backslash for each backslash and for the start of each marker.
_ADDED = r"""(length({0}) - length(replace({0}, '\', '')) + (length({0}) - length(replace(replace({0}, '</turn', ''), '<turn', ''))
  - len(regexp_extract_all({0}, '</turn')) * 5 - len(regexp_extract_all({0}, '<turn')) * 4)
  + CAST(coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda x: length(x) - 2)), 0) AS BIGINT))"""

CHAT = rf"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
each AS (
  SELECT *, length('### : <turn></turn>') + 1 + length(role) + length(text) + {_ADDED.format("role")} + {_ADDED.format("text")} AS chars
  FROM turns)
SELECT conv_id, COUNT(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(SUM(chars) AS BIGINT) AS formatted_chars
FROM each GROUP BY conv_id"""

#: Levels that the SQL has room for: 3^14 rows of a source.
_LEVELS = 14


def _tree(name: str, base: str, first: str) -> list[str]:
    """CTEs ``name0 .. name_LEVELS`` of nodes ``g, i, h, c`` (nodes of the group) from ``base(g, i, h)``, and folds
    ``name_f0 ..`` of ``r, g, i, h, proof`` from ``first`` (what selects the same, not folded yet)."""
    counted = "SELECT g, i, h, COUNT(*) OVER (PARTITION BY g) AS c FROM"
    out = [f"{name}0 AS MATERIALIZED ({counted} {base})", f"{name}_f0 AS MATERIALIZED ({first})"]
    for k in range(1, _LEVELS + 1):
        up = f"""SELECT g, i // 3 AS i, CASE WHEN any_value(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM {name}{k - 1} GROUP BY g, i // 3"""
        out.append(f"{name}{k} AS MATERIALIZED ({counted} ({up}))")
        out.append(
            f"""{name}_f{k} AS MATERIALIZED (
  SELECT f.r, f.g, f.i // 3 AS i,
         CASE WHEN any_value(s.c) = 1 THEN f.h ELSE sha256(string_agg(CASE WHEN s.i = f.i THEN f.h ELSE s.h END, '' ORDER BY s.i)) END AS h,
         f.proof || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i <> f.i), '') AS proof
  FROM {name}_f{k - 1} f JOIN {name}{k - 1} s ON s.g = f.g AND s.i // 3 = f.i // 3 GROUP BY f.r, f.g, f.i, f.h, f.proof)"""
        )
    return out


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _manifest() -> str:
    names = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")]
    hashed = lambda text: f"sha256({' || '.join(map(_field, [*names, text]))})"
    # bytes of the decimal id, each followed by eight steps of the reflected polynomial
    step = "CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    even = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda a, x: {step}), 4294967295) % 2 = 0"
    ctes = [
        f"leaves AS (SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, '') AS g, {hashed('text')} AS leaf, "
        f"{hashed('''CASE WHEN doc_id IS NOT NULL AND ''' + even + ''' THEN replace(text, chr(10), '') ELSE text END''')} AS claim FROM documents)",
        "ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i FROM leaves)",
        *_tree("n", "(SELECT g, i, leaf AS h FROM ranked)", "SELECT r, g, i, claim AS h, '' AS proof FROM ranked"),
        f"subroots AS MATERIALIZED (SELECT g AS source, '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM n{_LEVELS})",
        *_tree("m", "subroots", f"SELECT f.r, '' AS g, s.i, f.h, f.proof FROM n_f{_LEVELS} f JOIN subroots s ON s.source = f.g"),
    ]
    return f"""WITH {", ".join(ctes)}
SELECT l.doc_id, l.leaf, s.h AS subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM ranked l JOIN subroots s ON s.source = l.g JOIN m_f{_LEVELS} f ON f.r = l.r CROSS JOIN m{_LEVELS} t"""


MANIFEST = _manifest()

DIVERGENCE = rf"""WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
vocab AS (SELECT lang, term, COUNT(*) AS lang_count FROM words GROUP BY lang, term HAVING COUNT(DISTINCT r) >= 30),
sizes AS (SELECT lang, COUNT(*) AS v, SUM(lang_count) AS lang_n FROM vocab GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, COUNT(*) AS n FROM words JOIN vocab USING (lang, term) GROUP BY lang, source, term),
grid AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, SUM(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total, lang_count
  FROM groups JOIN vocab USING (lang) LEFT JOIN counts USING (lang, source, term)),
shares AS (
  SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (total + 5 * v) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (lang_count + 5)) // (lang_n + 5 * v) AS q
  FROM grid JOIN sizes USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT SUM(abs(x.p - y.p)) FROM shares x JOIN shares y USING (lang, term)
                   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
scored AS (
  SELECT * FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM scored)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50"""


#: A paragraph is a run of lines with words, two at least.
PARAGRAPHS = rf"""WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL),
each AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM texts),
placed AS (
  SELECT r, doc_id, i, SUM(length(line) + 1) OVER (PARTITION BY r ORDER BY i) - 1 AS "end", length(line) AS size,
         trim(regexp_replace(translate(line, '{_UPPER}', '{_LOWER}'), '[\x09-\x0D\x20]+', ' ', 'g')) AS words
  FROM each),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY r ORDER BY i) AS run FROM placed WHERE words <> ''),
units AS (
  SELECT doc_id, CAST(MIN("end" - size) AS INTEGER) AS start, CAST(MAX("end") AS INTEGER) AS "end", string_agg(words, ' ' ORDER BY i) AS unit
  FROM runs GROUP BY r, doc_id, run HAVING COUNT(*) > 1),
ranked AS (
  SELECT *, first(doc_id) OVER w AS kept_doc_id, first(start) OVER w AS kept_start
  FROM units WINDOW w AS (PARTITION BY unit ORDER BY doc_id, start))
SELECT doc_id, start, "end", kept_doc_id, kept_start FROM ranked WHERE doc_id <> kept_doc_id OR start <> kept_start"""

URL_RULES = rf"""WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(name, prefix, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, name || prefix AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(name || prefix) DESC) AS k
  FROM parts JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix))
SELECT p.page_id, p.host, p.path, f.rule, f.verdict FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1"""
