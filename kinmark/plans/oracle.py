"""The registered queries in DuckDB's SQL, written independently of the DataFrame plans: shared steps are common
table expressions, put in front of each query as far as it needs them."""

from __future__ import annotations

from kinmark.functions.text import ADDRESS_WORDS, ALIAS, DOMAIN_ENDS, LEGAL_FORMS, SCRIPTS
from kinmark.operators.blocking import DF_LEVELS, FAMILIES, BlockConfig

CFG = BlockConfig()
_quoted = lambda words: ", ".join(f"'{w}'" for w in words)


def _tidy(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace({x}, '&', ' and '), '[^0-9a-z\\x{{0900}}-\\x{{0dff}} ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def name_form(x: str) -> str:
    x = f"regexp_replace(lower(strip_accents({x})), '^.*?{ALIAS}\\s*:?\\s*', '')"
    return _tidy(f"regexp_replace(regexp_replace({x}, '\\bwww\\.', '', 'g'), '{DOMAIN_ENDS}', ' ', 'g')")


def address_form(x: str) -> str:
    x = f"regexp_replace(lower(strip_accents({x})), '<\\s*null\\s*>', ' ', 'g')"
    x = f"regexp_replace(replace({x}, '&', ' and '), '[^0-9a-z\\x{{0900}}-\\x{{0dff}} ]+', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '\\b(?:null|none|nil)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


def content(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '' AND w NOT IN ({_quoted(LEGAL_FORMS)}))"


def address_words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ({_quoted(ADDRESS_WORDS)})))"


def address_numbers(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, '[0-9]+'), lambda d: ltrim(d, '0')), lambda d: d <> ''))"


STEPS: dict[str, str] = {
    "rec": """SELECT 'S' || (1 + doc_id % 3) || '-' || (doc_id * 1000000 + i) AS entity_id, CAST(1 + doc_id % 3 AS INTEGER) AS src, lang AS country,
      array_to_string(w[18 * i + 1:18 * i + 6], ' ') AS business_name, array_to_string(w[18 * i + 7:18 * i + 18], ' ') || ' ' || (n_chars + i) AS business_address
      FROM (SELECT *, unnest(generate_series(0, (len(w) - 1) // 18)) AS i FROM (SELECT *, string_split(text, ' ') AS w FROM documents))""",
    "norm": f"SELECT *, {name_form('business_name')} AS name_norm, {address_form('business_address')} AS addr_norm FROM rec",
    "forms": f"""SELECT *, array_to_string({content("name_norm")}, ' ') AS name_core, array_to_string(list_sort(name_toks), ' ') AS name_key,
      replace(array_to_string({content("name_norm")}, ' '), ' ', '') AS name_core_nospace, replace(name_norm, ' ', '') AS name_nospace,
      regexp_matches(business_name, '[^\\x00-\\x7f]') AS name_nonascii, regexp_matches(business_address, '[^\\x00-\\x7f]') AS addr_nonascii
      FROM (SELECT *, list_distinct({content("name_norm")}) AS name_toks, {address_words("addr_norm")} AS addr_toks, {address_numbers("addr_norm")} AS addr_nums FROM norm)""",
    "toks": """SELECT country, entity_id, 'addr' AS kind, unnest(addr_toks) AS tok FROM forms UNION ALL SELECT country, entity_id, 'name', unnest(name_toks) FROM forms
      UNION ALL SELECT country, entity_id, 'num', unnest(addr_nums) FROM forms""",
    "vocab": "SELECT country, kind, tok, df, row_number() OVER (PARTITION BY country, kind ORDER BY df, tok) - 1 AS tid FROM (SELECT country, kind, tok, count(*) AS df FROM toks GROUP BY ALL)",
    "thr": "SELECT country, kind, " + ", ".join(f"count(*) FILTER (df <= {lv}) AS le_{lv}" for lv in DF_LEVELS) + " FROM vocab GROUP BY ALL",
    "lists": """SELECT f.*, coalesce(at_all, []) AS at_all, coalesce(mt_all, []) AS mt_all, coalesce(an_all, []) AS an_all FROM forms f LEFT JOIN (
      SELECT entity_id, list(tid ORDER BY tid) FILTER (kind = 'addr') AS at_all, list(tid ORDER BY tid) FILTER (kind = 'name') AS mt_all, list(tid ORDER BY tid) FILTER (kind = 'num') AS an_all
      FROM toks JOIN vocab USING (country, kind, tok) GROUP BY entity_id) USING (entity_id)""",
}


def _pair(f: int, x: str, y: str) -> str:
    return f"{f} * (1::BIGINT << 58) + greatest({x}, {y}) * (1::BIGINT << 29) + least({x}, {y})"


def _two(f: int, x: str, y: str) -> str:
    return f"{f} * (1::BIGINT << 58) + {x} * (1::BIGINT << 29) + {y}"


def _hash(f: int, x: str) -> str:
    return f"{f} * (1::BIGINT << 58) + ('0x' || substr(md5({x}), 1, 14))::BIGINT"


def _keys() -> str:
    at = [f"at_all[{i + 1}]" for i in range(CFG.address_tokens)]
    mt = [f"mt_all[{i + 1}]" for i in range(CFG.name_tokens)]
    an = [f"an_all[{i + 1}]" for i in range(CFG.address_numbers)]
    sets = [
        [_pair(0, at[i], at[j]) for i in range(len(at)) for j in range(i + 1, len(at))], [_two(1, n, a) for n in an for a in at[:2]], [_two(2, m, a) for m in mt[:2] for a in at[:2]],
        [_pair(3, mt[i], mt[j]) for i in range(len(mt)) for j in range(i + 1, len(mt))], [_two(4, m, an[0]) for m in mt[:2]], [f"CASE WHEN length(name_key) >= 3 THEN {_hash(5, 'name_key')} END"],
        [f"""CASE WHEN len(addr_toks) >= 2 THEN {_hash(6, "array_to_string(list_sort(addr_toks), ' ') || ' # ' || array_to_string(list_sort(addr_nums), ' ')")} END"""],
        [f"CASE WHEN length(name_core_nospace) >= 6 THEN {_hash(7, 'name_core_nospace')} END"],
    ]
    parts = [f"SELECT country, entity_id, src, {f} AS fam, unnest([{', '.join(s)}]) AS key FROM lists" for f, s in enumerate(sets)]
    return f"SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)}) WHERE key IS NOT NULL"


def _caps(default: int = CFG.max_block) -> str:
    return "CASE WHEN fam IN (5, 6, 7) THEN 3000 ELSE " + str(default) + " END"




STEPS |= {
    "keys": _keys(),
    "index_keys": f"SELECT k.* FROM keys k JOIN (SELECT country, fam, key, count(*) AS n FROM keys WHERE src > 1 GROUP BY ALL) s USING (country, fam, key) WHERE k.src > 1 AND s.n <= {_caps()}",
    "cand": "SELECT a.country, a.entity_id AS a_id, b.entity_id AS b_id, count(*) AS n_keys, bit_or(1 << a.fam) AS fam_mask FROM keys a JOIN index_keys b USING (country, key) WHERE a.src = 1 GROUP BY ALL",
    "truth": """SELECT 'S1-' || (a * 1000000 + i) AS a_id, 'S' || (1 + b % 3) || '-' || (b * 1000000 + i) AS b_id FROM (SELECT x.doc_id AS a, y.doc_id AS b, unnest(generate_series(0, (len(string_split(x.text, ' ')) - 1) // 18)) AS i
      FROM documents x JOIN documents y ON x.text = y.text AND x.lang = y.lang WHERE x.doc_id % 3 = 0 AND y.doc_id % 3 > 0)""",
    "cheap0": "SELECT c.*, a.at_all AS a_at, b.at_all AS b_at, a.mt_all AS a_mt, b.mt_all AS b_mt, a.an_all AS a_an, b.an_all AS b_an FROM cand c JOIN lists a ON a.entity_id = a_id JOIN lists b ON b.entity_id = b_id",
    "wide": "SELECT country, " + ", ".join(f"max(le_{lv}) FILTER (kind = '{k}') AS {s}_le_{lv}" for k, s in (("addr", "at"), ("name", "mt"), ("num", "an")) for lv in DF_LEVELS) + " FROM thr GROUP BY country",
}


def _cheap() -> str:
    cols = ["country", "a_id", "b_id", "n_keys", "fam_mask"]
    for s, n in (("at", 3), ("mt", 3), ("an", 2)):
        shared, la, lb = f"list_intersect(a_{s}, b_{s})", f"len(a_{s})", f"len(b_{s})"
        size = f"len({shared})"
        cols += [
            f"{size} AS {s}_inter", f"CASE WHEN {la} + {lb} - {size} > 0 THEN {size} / ({la} + {lb} - {size}) ELSE 0.0 END AS {s}_jac", f"CASE WHEN least({la}, {lb}) > 0 THEN {size} / least({la}, {lb}) ELSE 0.0 END AS {s}_cont",
            f"{la} AS {s}_alen", f"{lb} AS {s}_blen", f"ln(1 + coalesce(list_min({shared}), 1 << 30)) AS {s}_minid",
        ]
        cols += [f"len(list_filter({shared}, lambda t: t < coalesce({s}_le_{DF_LEVELS[i]}, 0))) AS {s}_r{i}" for i in range(n)]
    return f"SELECT {', '.join(cols)} FROM cheap0 LEFT JOIN wide USING (country)"


STEPS |= {
    "cheap": _cheap(),
    "scored": "SELECT *, 3.0 * at_cont + 2.5 * mt_cont + 1.0 * an_cont + 0.10 * n_keys + 0.6 * at_r0 + 0.5 * mt_r0 + 0.25 * at_r1 + 0.2 * mt_r1 AS score FROM cheap",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY round(score, 9) DESC, b_id) AS rank FROM scored",
    "text_pairs": "SELECT r.country, r.a_id, r.b_id, r.score, " + ", ".join(f"{p}.{c} AS {p}_{c}" for p in "ab" for c in ("name_core", "name_key", "name_core_nospace", "name_norm", "addr_norm", "name_nonascii", "addr_nonascii")) + " FROM ranked r JOIN forms a ON a.entity_id = a_id JOIN forms b ON b.entity_id = b_id WHERE rank <= 20",
    "pairs": "SELECT l_orderkey AS a, l_partkey AS b, max(round(l_extendedprice / 105000.0, 6)) AS p, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y, min(l_linenumber % 2) AS is_s3 FROM lineitem GROUP BY ALL",
    "counts": "SELECT o_orderkey AS a, CAST(coalesce(n, 0) AS BIGINT) AS n_true FROM orders LEFT JOIN (SELECT a, sum(y) AS n FROM pairs GROUP BY a) t ON t.a = o_orderkey",
}

_NEEDS = {
    "norm": ["rec"], "forms": ["norm"], "toks": ["forms"], "vocab": ["toks"], "thr": ["vocab"], "lists": ["forms", "toks", "vocab"], "keys": ["lists"], "index_keys": ["keys"], "cand": ["keys", "index_keys"], "cheap0": ["cand", "lists"], "wide": ["thr"],
    "cheap": ["cheap0", "wide"], "scored": ["cheap"], "ranked": ["scored"], "text_pairs": ["ranked", "forms"], "counts": ["pairs"],
}


def after(steps: str, query: str, **more: str) -> str:
    """WITH the named steps (or what is given in their place) and all they need, then further ones, then the query."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for s in steps.split():
        add(s)
    # each step is used several times: kept once
    ctes = [f"{s} AS MATERIALIZED ({more.pop(s, STEPS[s])})" for s in order] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH {', '.join(ctes)} {query}" if ctes else query


F_HALF = "CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_true = 0 OR n_pred = 0 OR n_hit = 0 THEN 0.0 ELSE 1.25 * (n_hit / n_pred) * (n_hit / n_true) / (0.25 * (n_hit / n_pred) + n_hit / n_true) END"


def entities(chosen: str) -> str:
    """(a, n_true, n_pred, n_hit, f) of chosen (a, y)."""
    return f"SELECT *, {F_HALF} AS f FROM (SELECT c.a, n_true, CAST(coalesce(n_pred, 0) AS BIGINT) AS n_pred, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit FROM counts c LEFT JOIN (SELECT a, count(*) AS n_pred, sum(y) AS n_hit FROM {chosen} GROUP BY a) g USING (a))"


def summary(source: str) -> str:
    rate = lambda x, y, n: f"round(coalesce(({x}) / nullif({y}, 0), 0.0), 9) AS {n}"
    single, many, pred = "count(*) FILTER (n_true = 0)", "count(*) FILTER (n_true > 0)", "sum(n_pred)"
    return "SELECT " + ", ".join(
        [
            "count(*) AS n_entities", "CAST(sum(n_true) AS BIGINT) AS n_true", "CAST(sum(n_pred) AS BIGINT) AS n_pred", "CAST(sum(n_hit) AS BIGINT) AS n_hit", f"{single} AS n_singletons", "CAST(sum(n_pred) - sum(n_hit) AS BIGINT) AS n_false",
            rate("sum(f)", "count(*)", "macro_f05"), rate("sum(n_hit)", pred, "micro_precision"), rate("sum(n_hit)", "sum(n_true)", "micro_recall"), rate("count(*) FILTER (n_true = 0 AND n_pred = 0)", single, "singleton_accuracy"),
            rate("count(*) FILTER (n_true = 0 AND n_pred > 0)", single, "singleton_false_merge_rate"), rate("sum(f) FILTER (n_true = 0)", single, "macro_f05_singletons"), rate("sum(f) FILTER (n_true > 0)", many, "macro_f05_matched"),
            rate("100 * count(*) FILTER (n_true > 0 AND n_pred = 0)", many, "matched_all_missed_percent"), rate("sum(n_pred) - sum(n_hit)", pred, "pair_fp_rate"), rate(pred, "count(*)", "mean_pred"), rate("sum(n_true)", "count(*)", "mean_true"),
            rate("count(*) FILTER (n_pred = 0)", "count(*)", "empty_share"), rate("count(*) FILTER (n_pred = n_true AND n_hit = n_true)", "count(*)", "perfect_share"),
        ]
    ) + f" FROM {source}"


#: Passages and whole documents as records, in the place of ``rec``.
PASSAGES = """SELECT 'S1-' || (item_id * 1000000 + i) AS entity_id, 1 AS src, 'all' AS country, array_to_string(w[18 * i + 1:18 * i + 18], ' ') AS business_name, '' AS business_address
  FROM (SELECT *, unnest(generate_series(0, (len(w) - 1) // 18)) AS i FROM (SELECT *, string_split(text, ' ') AS w FROM benchmark))
  UNION ALL SELECT 'S2-' || (doc_id * 1000000 + i), 2, 'all', array_to_string(w[9 * i + 1:9 * i + 18], ' '), ''
  FROM (SELECT *, unnest(generate_series(0, greatest(0, (len(w) - 10) // 9))) AS i FROM (SELECT *, string_split(text, ' ') AS w FROM documents))"""



def common_length(x: str, y: str) -> str:
    """Length of the longest common subsequence of two string columns: the table's rows, folded over the first."""
    letter = lambda t, i: f"unicode(substr({t}, {i}, 1))::BIGINT"
    matched = f"list_max(list_transform(list_filter(generate_series(1, j), lambda k: {letter(y, 'k')} = c[1]), lambda k: r[k] + 1))"
    row = f"list_transform(generate_series(0, length({y})), lambda j: greatest(r[j + 1], coalesce({matched}, 0)))"
    return f"list_reduce(list_transform(generate_series(1, length({x})), lambda i: [{letter(x, 'i')}]), lambda r, c: {row}, list_transform(generate_series(0, length({y})), lambda j: 0::BIGINT))[length({y}) + 1]"


def indel_ratio(x: str, y: str) -> str:
    return f"CASE WHEN {x} = '' AND {y} = '' THEN 1.0 ELSE 2 * {common_length(x, y)} / (length({x}) + length({y})) END"


FAMILY_ROWS = ", ".join(f"({i}, '{f}')" for i, f in enumerate(FAMILIES))
SCRIPT_CASES = " ".join(f"WHEN regexp_matches(c, '\\p{{{s}}}') THEN '{s.upper()}'" for s in SCRIPTS)
