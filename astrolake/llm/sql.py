"""DuckDB SQL for the queries of the corpus operators that SQL can express."""

OP10 = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         '1:' || coalesce(doc_id::varchar, 'null') AS key
  FROM documents
), sums AS (
  SELECT source, sum(size)::bigint AS source_size, avg(CASE WHEN size > 0 THEN size END) AS mean FROM rows GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1]::double AS weight,
         3.0::double * source_size AS cap
  FROM sums
), levels AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed
), final AS (
  SELECT arg_min(level, cap / weight) AS final FROM levels WHERE level <= cap / weight
), plan AS (
  SELECT source, source_size, mean, CASE WHEN final IS NULL OR weight * final > cap THEN cap ELSE weight * final END AS target FROM levels, final
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::bigint AS whole FROM plan
), rests AS (
  SELECT *, target - whole * source_size AS rest FROM parts
), ranked AS (
  SELECT r.*, p.source_size, p.target, p.whole, p.rest,
         (('0x' || substr(md5(key), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double AS u,
         least(greatest(p.rest / p.source_size, 1e-9::double), 1 - 1e-9::double) AS f, p.mean
  FROM rows r JOIN rests p ON r.source IS NOT DISTINCT FROM p.source
), odds AS (
  SELECT *, CASE WHEN size > 0 THEN (u / (1 - u)) / (f / (1 - f) * pow(size / mean, 0.25)) END AS q FROM ranked
), along AS (
  SELECT *, sum(size) OVER (PARTITION BY source, size > 0 ORDER BY q, key, size ROWS UNBOUNDED PRECEDING) AS reach FROM odds
), chosen AS (
  SELECT *, CASE WHEN size = 0 THEN 0
                 ELSE whole + CASE WHEN reach - rest <= rest - (reach - size) THEN 1 ELSE 0 END END::bigint AS copies
  FROM along
)
SELECT doc_id, size::bigint AS size, source_size, target, copies, (copies * size)::bigint AS taken FROM chosen
"""

OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(item_id::varchar, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), starts AS (
  SELECT item, w, least(len(w), 10)::bigint AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM starts
), sizes AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n
), hits AS (
  SELECT rid, p, n, item FROM (SELECT rid, p, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM places) JOIN windows USING (n, g)
), covered AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM hits)) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""

OP11 = r"""
WITH r AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::varchar, '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM r
), d AS (
  SELECT *, len(u)::bigint AS n, ('0x' || substr(h, 1, 8))::bigint % (len(u) + 1) AS c1, ('0x' || substr(h, 9, 8))::bigint % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::bigint % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::bigint % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, CASE WHEN form <> 'plain' THEN coalesce(array_to_string(u[1 : least(c1, c2)], ''), '') END AS a,
         CASE WHEN form <> 'plain' THEN coalesce(array_to_string(u[least(c1, c2) + 1 : greatest(c1, c2)], ''), '') END AS b,
         CASE WHEN form <> 'plain' THEN coalesce(array_to_string(u[greatest(c1, c2) + 1 : n], ''), '') END AS c
  FROM d
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END AS o FROM p
), s AS (
  SELECT *, CASE WHEN form <> 'plain' THEN string_split_regex(o, '<[PSM]>') END AS s FROM o
)
SELECT doc_id, n, form, length(a)::bigint AS prefix_chars, length(b)::bigint AS middle_chars, sha256(o) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN s[2] || s[4] || s[3] ELSE s[3] || s[4] || s[2] END) AS restored_sha256
FROM s
"""


def _op12(rounds: int = 6) -> str:
    """The rounds one below the other: nearest entries of all parts, then floors of means."""
    kept = """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS MATERIALIZED (
  SELECT rid, vec_id, (i // w)::bigint AS p, (i % w)::bigint AS j, floor(4096 * v[i + 1]::double)::bigint AS x
  FROM (SELECT *, len(v) // 8 AS w, unnest(range(len(v))) AS i FROM kept)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p, j ORDER BY vec_id) - 1 AS e, j, x AS y FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)
)"""

    def near(i: int) -> str:
        return f"""near{i} AS MATERIALIZED (
  SELECT rid, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT rid, p, e, sum((x - y) * (x - y))::bigint AS d FROM parts JOIN book{i} USING (p, j) GROUP BY rid, p, e) GROUP BY rid, p
)"""

    steps = [kept]
    for i in range(rounds):
        steps += [near(i), f"""book{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.j, CASE WHEN c IS NULL THEN y ELSE (s - ((s % c) + c) % c) // c END::bigint AS y
  FROM book{i} b LEFT JOIN (SELECT p, e, j, sum(x)::bigint AS s, count(*) AS c FROM parts JOIN near{i} USING (rid, p) GROUP BY p, e, j) m ON b.p = m.p AND b.e = m.e AND b.j = m.j
)"""]
    steps.append(near(rounds))
    return "WITH " + ", ".join(steps) + f""", codes AS (
  SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::bigint AS error FROM near{rounds} GROUP BY rid
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error,
       (SELECT sha256(string_agg(y::varchar, ',' ORDER BY p, e, j)) FROM book{rounds}) AS codebooks_sha256
FROM codes JOIN kept USING (rid)"""


OP13 = """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), products AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score FROM kept q JOIN kept c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::int AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM products
) WHERE rank <= 20
"""

ORACLE_SQL: dict[str, str] = {"op8_decontamination": OP8, "op10_source_mix": OP10, "op11_fill_middle": OP11, "op12_vector_codes": _op12(), "op13_pivot_search": OP13}
