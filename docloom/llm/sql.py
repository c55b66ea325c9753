"""DuckDB SQL for the queries that SQL can express on whole tables."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, lens WHERE len(w) >= n)
),
hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_DRAW = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"

OP11 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t FROM documents
),
c AS (SELECT *, len(t) AS n, {_DRAW.format(1)} % (len(t) + 1) AS c1, {_DRAW.format(9)} % (len(t) + 1) AS c2, {_DRAW.format(17)} % 100 AS h3, {_DRAW.format(25)} % 100 AS h4 FROM d),
f AS (
  SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(t[1 : least(c1, c2)], '') AS p, array_to_string(t[least(c1, c2) + 1 : greatest(c1, c2)], '') AS m, array_to_string(t[greatest(c1, c2) + 1 :], '') AS s FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM f
"""


def merkle_levels(name: str, start: str, height: int) -> list[str]:
    """Common tables name_0 to name_height: the nodes (g, pos, n, h) of each level; groups of one node stay as they are."""
    out = [f"{name}_0 AS ({start})"]
    for k in range(height):
        below = f"SELECT g, pos // 2 AS up, (n + 1) // 2 AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}_{k} WHERE n > 1 GROUP BY 1, 2, 3"
        out.append(f"{name}_{k + 1} AS (SELECT g, up AS pos, n, h FROM ({below}) UNION ALL SELECT g, pos, n, h FROM {name}_{k} WHERE n = 1)")
    return out


def _merkle_paths(name: str, rows: str, carry: str, height: int) -> list[str]:
    """Common tables that climb: each row's sibling hashes (sib) and folded hash (f), level by level."""
    out = [f"{name}_p0 AS ({rows})"]
    for k in range(height):
        other = "coalesce(o.h, '')"
        fold = f"CASE WHEN r.n = 1 THEN r.f WHEN r.pos % 2 = 0 THEN sha256(r.f || {other}) ELSE sha256({other} || r.f) END"
        out.append(
            f"{name}_p{k + 1} AS (SELECT {carry}, r.g, CASE WHEN r.n = 1 THEN r.pos ELSE r.pos // 2 END AS pos, CASE WHEN r.n = 1 THEN r.n ELSE (r.n + 1) // 2 END AS n, "
            f"r.sib || CASE WHEN r.n = 1 THEN '' ELSE {other} END AS sib, {fold} AS f FROM {name}_p{k} r LEFT JOIN {name}_{k} o ON r.g IS NOT DISTINCT FROM o.g AND o.pos = xor(r.pos, 1) AND r.n > 1)"
        )
    return out


LOW, HIGH = 20, 5  # levels: enough for 2^20 rows of a language and 32 languages
_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_CRC = "list_reduce([CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')], lambda a, c: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(a, c)), 4294967295)"


def op13() -> str:
    fields = [_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [*fields[:3], _FIELD.format("(n_chars + 1)"), fields[4]]
    first = "SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM hashed"
    parts = [
        f"hashed AS (SELECT doc_id, lang AS g, sha256({' || '.join(fields)}) AS h, CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 THEN sha256({' || '.join(more)}) END AS other FROM documents)",
        f"leaves AS ({first})",
        *merkle_levels("low", "SELECT g, pos, n, h FROM leaves", LOW),
        *merkle_levels("high", f"SELECT 0 AS g, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h FROM low_{LOW}", HIGH),
        *_merkle_paths("low", "SELECT doc_id, h AS leaf, g, pos, n, '' AS sib, coalesce(other, h) AS f FROM leaves", "doc_id, leaf", LOW),
        f"names AS (SELECT g AS lang, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h AS subroot FROM low_{LOW})",
        *_merkle_paths("high", f"SELECT doc_id, leaf, subroot, 0 AS g, names.pos, names.n, sib, f FROM low_p{LOW} r JOIN names ON r.g IS NOT DISTINCT FROM names.lang", "doc_id, leaf, subroot", HIGH),
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = h AS verified FROM high_p{HIGH}, high_{HIGH}"


ORACLES = {"op3_winnowing": OP3, "op11_fill_in_middle": OP11, "op13_merkle_manifest": op13()}
