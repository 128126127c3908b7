"""The queries in DuckDB SQL, over whole tables. Where SQL cannot say it (seeded edits, iterations), there is none."""

from __future__ import annotations

import re

from millrace.functions import constants as K
from millrace.sources.queries import io_sql

#: Parameters of the checker queries.
CHECK_ARGS: dict[str, dict] = {
    "length_constraint:word_count": {"target": 50, "relation": "at_least"},
    "length_constraint:sentence_count": {"target": 4, "relation": "At Most"},
    "length_constraint:paragraph_count": {"target": 2, "relation": "exactly"},
    "keywords:existence": {"keywords": ["the", "Of"]},
    "keywords:frequency": {"keyword": "The", "target": 6},
    "keywords:forbidden": {"keywords": ["kayak", "Quilt"]},
    "start_with": {"value": "The "},
    "end_with": {"value": "."},
    "capitalization:all_caps_count": {"target": 0},
    "capitalization:all_lowercase": {},
    "format:bullet_points": {"target": 3},
    "format:numbered_list": {},
    "format:sections": {"target": 1, "relation": "gt"},
    "format:json": {},
    "language:english": {},
    "punctuation:no_comma": {},
    "detectable_content:postscript": {},
    "detectable_format:highlight": {},
}


def q(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"


WS, ANYWORD = K.WS, q(K.WORD + "+")


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def trim_ws(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "")


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {q(WS + '+')}), lambda w: w <> '')"


def html(x: str) -> str:
    return sub(sub(x, K.HTML_TAG, " "), K.HTML_ENTITY, " ")


def emojis(x: str) -> str:
    return sub(x, K.EMOJI, " ")


def unknown(x: str) -> str:
    return sub(sub(sub(f"nfc_normalize({x})", K.CONTROL, " "), K.INVISIBLE, ""), f"[^{K.NOT_SYMBOL}]{{4,}}", " ")


def symbols(x: str) -> str:
    src = "".join(K.SYMBOL_FORMS.values())
    dst = "".join(f * len(s) for f, s in K.SYMBOL_FORMS.items())
    return sub(sub(f"translate(replace({x}, '…', '...'), {q(src)}, {q(dst)})", r"\p{Zs}", " "), r"[^\x{0}-\x{7F}\p{L}\p{M}\p{N}]", "")


def spaces(x: str) -> str:
    return f"trim({sub(x, WS + '+', ' ')})"


def clean(x: str) -> str:
    return spaces(symbols(unknown(emojis(html(x)))))


def stopless(x: str) -> str:
    stop = "[" + ", ".join(map(q, K.STOPWORDS)) + "]"
    return f"array_to_string(list_filter({words(x)}, lambda w: NOT list_contains({stop}, lower(trim(w, {q(K.PUNCTUATION)})))), ' ')"


def finger(x: str) -> str:
    return f"sha256({spaces(f'lower({x})')})"


def python_text(x: str) -> str:
    esc = f"replace(replace(replace(replace({x}, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"
    return f"CASE WHEN contains({x}, chr(39)) AND NOT contains({x}, chr(34)) THEN chr(34) || {esc} || chr(34) ELSE chr(39) || replace({esc}, chr(39), chr(92) || chr(39)) || chr(39) END"


def captured(c: str, pattern: str) -> str:
    n = re.compile(pattern).groups
    take = lambda i: f"regexp_extract_all({c}, {q('(?i)' + pattern)}, {i})"
    if n < 2:
        return take(n)
    shown = " || ', ' || ".join(f"({python_text(f'{take(i + 1)}[i]')})" for i in range(n))
    return f"list_transform(range(1, len({take(0)}) + 1), lambda i: '(' || {shown} || ')')"


def parts(x: str, pattern: str) -> str:
    return f"len(list_filter(string_split_regex({x}, {q(pattern)}), lambda s: {trim_ws('s')} <> ''))"


def pieces(x: str) -> str:
    return f"len(string_split_regex({trim_ws(x)}, '[.!?]+'))"


def count_in(x: str, needle: str) -> str:
    return f"CASE WHEN {needle} = '' THEN length({x}) + 1 ELSE (length({x}) - length(replace({x}, {needle}, ''))) // greatest(length({needle}), 1) END"


def entities(x: str) -> str:
    edge = q(K.EDGE + "*")
    tails = f"flatten(list_transform(string_split_regex({x}, {q('[.!?]' + WS)}), lambda s: ({words('s')})[2:]))"
    bare = f"list_transform({tails}, lambda w: trim(w, {edge}))"
    return f"list_distinct(list_transform(list_filter({bare}, lambda w: length(w) >= 2 AND regexp_matches(w, '^\\p{{Lu}}') AND w <> upper(w)), lambda w: lower(w)))"


def numbers(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, {ANYWORD}), lambda w: regexp_full_match(w, '[0-9]+'))"


def listed(x: str) -> str:
    return f"array_to_string(list_sort({x}), '|')"


def described(m: str, word: str) -> str:
    lists = f"list_filter(flatten(list_filter(map_values({m}), lambda l: l IS NOT NULL)), lambda d: d IS NOT NULL)"
    return f"coalesce(list_transform(flatten(list_transform({lists}, lambda d: {words('d')})), lambda w: {word}), [])"


def categories(m: str) -> str:
    return f"coalesce(list_transform(map_keys({m}), lambda k: lower(k)), [])"


def strings(xs: list[str]) -> str:
    return "[" + ", ".join(map(q, xs)) + "]::VARCHAR[]"


def protected(x: str, m: str) -> str:
    quoted = f"list_transform(flatten(list_transform(list_transform(regexp_extract_all({x}, {q(chr(34) + '.*?' + chr(34) + '|' + chr(39) + '.*?' + chr(39))}), lambda s: substr(s, 2, length(s) - 2)), lambda s: {words('s')})), lambda w: lower(w))"
    return f"list_distinct(flatten([{numbers(x)}, {quoted}, {categories(m)}, {described(m, f'lower(trim(w, {q(K.EDGE)}))')}, {strings(K.FORMAT_WORDS)}, {entities(x)}]))"


def constrained(x: str, m: str) -> str:
    quoted = f"list_transform(regexp_extract_all({x}, {q('[' + chr(39) + chr(34) + ']([^' + chr(39) + chr(34) + ']+)[' + chr(39) + chr(34) + ']')}, 1), lambda s: lower(s))"
    present = f"list_filter({strings(K.FORMAT_WORDS_BT)}, lambda w: contains(lower({x}), w))"
    return f"list_distinct(flatten([{numbers(x)}, {quoted}, {present}, {categories(m)}, {described(m, 'lower(w)')}, {entities(x)}]))"


def printable(x: str) -> str:
    return f"CASE WHEN length({x}) > 0 THEN length(regexp_replace({x}, '[\\p{{C}}\\p{{Zl}}\\p{{Zp}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', '', 'g'))::DOUBLE / length({x}) ELSE 0.0 END"


def category(x: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in K.CATEGORY_NAMES.items())
    return f"CASE lower({trim_ws(x)}) {cases} ELSE replace({trim_ws(x)}, ' ', '_') END"


def level(n: str) -> str:
    return f"CASE WHEN {n} <= 2 THEN 'L1' WHEN {n} <= 4 THEN 'L2' WHEN {n} <= 7 THEN 'L3' ELSE 'L4' END"


def compared(n: str, target: str, relation: str) -> str:
    rel = f"replace(lower({trim_ws(f'coalesce({relation}, {q("at_least")})')}), ' ', '_')"
    ops = {"le": "<=", "eq": "=", "gt": ">", "lt": "<"}
    return "CASE " + " ".join(f"WHEN {rel} IN ({', '.join(map(q, K.RELATIONS[k]))}) THEN {n} {op} {target}" for k, op in ops.items()) + f" ELSE {n} >= {target} END"


def detected(label: str) -> str:
    return f"CASE WHEN regexp_full_match({label}, '[a-z][a-z]') AND {label} <> 'xx' THEN {label} END"


def integrity(m: str, n: str) -> str:
    lists = f"map_values({m})"
    return f"""CASE WHEN {m} IS NULL OR cardinality({m}) = 0 THEN 'missing'
        WHEN len(list_filter({lists}, lambda l: l IS NULL OR len(l) = 0)) > 0 THEN 'empty_category'
        WHEN len(list_filter(flatten({lists}), lambda d: d IS NULL OR {trim_ws('d')} = '')) > 0 THEN 'blank_item'
        WHEN {n} IS NOT NULL AND {n} <> len(flatten({lists})) THEN 'count_mismatch' END"""


GATES = f"""WHEN len({words('p')}) < 15 THEN 'too_short' WHEN {printable('p')} < 0.85 THEN 'unprintable'
        WHEN {trim_ws('r')} = '' THEN 'empty_response' WHEN ({integrity('added_constraint', 'added_constraint_num')}) IS NOT NULL THEN 'bad_constraint'"""
GATED = f"""WITH c AS (SELECT *, coalesce({clean('winner_prompt')}, '') AS p, coalesce({clean('response_of_winner_prompt')}, '') AS r FROM instruction_records),
    g AS (SELECT *, CASE WHEN {detected('prompt_lang')} <> 'en' THEN 'language' {GATES} END AS skip_reason FROM c)"""
KEPT = f"{GATED}, f AS (SELECT *, {finger(stopless('p'))} AS fp FROM g), k AS (SELECT *, skip_reason IS NULL AND line_no = min(CASE WHEN skip_reason IS NULL THEN line_no END) OVER (PARTITION BY fp) AS first FROM f)"


def _checks() -> dict[str, str]:
    """SQL of each checker over ``response`` with a constraint's fields in scope as target, relation, keywords, keyword, value."""
    lines = f"list_transform(string_split(response, chr(10)), lambda x: {trim_ws('x')})"
    kws = "coalesce(keywords, CASE WHEN keyword IS NOT NULL THEN [keyword] ELSE []::VARCHAR[] END)"
    no_null = f"len(list_filter({kws}, lambda k: k IS NULL)) = 0"
    tgt = "CASE WHEN target IS NOT NULL THEN target ELSE TRY_CAST(value AS INTEGER) END"
    phrase = "lower(coalesce(target::VARCHAR, value, ''))"
    first = "lower(coalesce(keyword, keywords[1]))"
    runs = "list_transform(regexp_extract_all(response, '\\*+'), lambda s: length(s))"
    body = trim_ws("response")
    return {
        "length_constraint:word_count": compared(f"len({words('response')})", tgt, "relation"),
        "length_constraint:sentence_count": compared(parts("response", "[.!?]+"), tgt, "relation"),
        "length_constraint:paragraph_count": compared(parts("response", r"\n\n+"), tgt, "relation"),
        "keywords:existence": f"CASE WHEN {no_null} THEN len(list_filter({kws}, lambda k: NOT contains(lower(response), lower(k)))) = 0 END",
        "keywords:frequency": compared(f"({count_in('lower(response)', first)})", tgt, "relation"),
        "keywords:forbidden": f"CASE WHEN {no_null} THEN len(list_filter({kws}, lambda k: contains(lower(response), lower(k)))) = 0 END",
        "start_with": f"starts_with(lower({body}), {phrase})",
        "end_with": f"ends_with(lower({body}), {phrase})",
        "capitalization:all_caps_count": compared(f"len(list_filter({words('response')}, lambda w: w = upper(w) AND regexp_full_match(w, '\\p{{L}}+')))", tgt, "coalesce(relation, 'at_most')"),
        "capitalization:all_lowercase": "response = lower(response)",
        "format:bullet_points": compared(f"len(list_filter({lines}, lambda x: regexp_matches(x, '^[•\\-*]\\s')))", tgt, "relation"),
        "format:numbered_list": f"len(list_filter({lines}, lambda x: regexp_matches(x, '^[0-9]+[.)]\\s'))) > 0",
        "format:sections": compared("((length(response) - length(replace(response, '##', ''))) // 2)", tgt, "relation"),
        "format:json": f"CASE WHEN {body} = '' THEN false ELSE json_valid({body}) END",
        "language:english": f"CASE WHEN len({words('response')}) = 0 THEN true ELSE len(list_filter({words('response')}, lambda w: regexp_full_match(w, '[\\x{{0}}-\\x{{7F}}]*')))::DOUBLE / len({words('response')}) > 0.8 END",
        "punctuation:no_comma": "NOT contains(response, ',')",
        "detectable_content:postscript": "contains(lower(response), 'p.s.') OR contains(lower(response), 'ps:')",
        # without a target: any bold span, or any two single stars in a row among the runs of stars
        "detectable_format:highlight": f"regexp_matches(response, '\\*\\*[^*]+\\*\\*') OR contains('|' || array_to_string({runs}, '|') || '|', '|1|1|')",
    }


CHECKS = _checks()


def _arg(kind: str, name: str) -> str:
    v = CHECK_ARGS[kind].get(name)
    types = {"target": "INTEGER", "keywords": "VARCHAR[]"}
    return f"{'NULL' if v is None else strings(v) if isinstance(v, list) else q(v) if isinstance(v, str) else v}::{types.get(name, 'VARCHAR')} AS {name}"


def _check_queries() -> dict[str, str]:
    out = {}
    for kind, sql in CHECKS.items():
        args = ", ".join(_arg(kind, n) for n in ("target", "relation", "keywords", "keyword", "value"))
        out["cc_" + kind.split(":")[-1]] = f"SELECT resp_id, {sql} AS passed FROM (SELECT *, {args} FROM model_responses WHERE response IS NOT NULL)"
    case = "CASE type " + " ".join(f"WHEN {q(k)} THEN ({s})" for k, s in CHECKS.items()) + " END"
    each = f"""WITH j AS (SELECT m.resp_id, m.response, e.constraints FROM model_responses m JOIN eval_prompts e USING (id) WHERE m.response IS NOT NULL),
        c AS (SELECT resp_id, response, unnest(constraints) AS c, generate_subscripts(constraints, 1) - 1 AS pos FROM j),
        f AS (SELECT resp_id, response, pos, c.type AS type, c.target AS target, c.relation AS relation, c.keywords AS keywords, c.keyword AS keyword, c.value AS value FROM c),
        v AS (SELECT resp_id, pos::BIGINT AS pos, type, {case} AS passed FROM f)"""
    out["cc_each"] = f"{each} SELECT * FROM v"
    out["cc_check_all"] = f"""{each}, a AS (SELECT resp_id, count(*) AS k, count(passed) AS n, count(*) FILTER (WHERE passed) AS p FROM v GROUP BY resp_id)
        SELECT j.resp_id, coalesce(k, 0)::BIGINT AS num_constraints, coalesce(n, 0)::BIGINT AS num_checked, coalesce(p, 0)::BIGINT AS num_passed,
        CASE WHEN n > 0 THEN p::DOUBLE / n ELSE 0.0 END AS per_constraint_csr, coalesce(n > 0 AND n = p, false) AS hard_csr FROM j LEFT JOIN a USING (resp_id)"""
    return out


def _shredded() -> dict[str, str]:
    """The nodes of the nested cells by recursion over objects, arrays, and texts that hold either, and the tables of them."""

    def unwrap(x: str) -> str:
        t = f"json_extract_string({x}, '$')"
        return f"CASE WHEN json_type({x}) <> 'VARCHAR' THEN {x} WHEN NOT json_valid({t}) THEN {x} WHEN json_type({t}) IN ('OBJECT', 'ARRAY') THEN {t}::JSON ELSE {x} END"

    names = ["added_constraint", "rule_evaluate_dict", "added_constraint_from_llm"]
    parts = """CASE json_type(v) WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k, i: struct_pack(k := k, o := i - 1, c := json_extract(v, '$."' || k || '"')))
            ELSE list_transform(range(json_array_length(v)::BIGINT), lambda i: struct_pack(k := NULL::VARCHAR, o := i, c := json_extract(v, '$[' || i || ']'))) END"""
    kind = "CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"
    base = f"""WITH RECURSIVE cells AS (SELECT rec_no, unnest({strings(names)}) AS field, unnest([{', '.join(names)}]) AS cell FROM constraint_records),
        roots AS (SELECT rec_no, field, ('0x' || substr(md5(cell), 1, 15))::BIGINT AS cell, CASE WHEN json_valid(cell) THEN cell::JSON END AS v FROM cells),
        n AS (SELECT rec_no, field, cell, NULL::VARCHAR AS path, []::BIGINT[] AS ords, NULL::VARCHAR AS label, NULL::VARCHAR AS above, NULL::VARCHAR AS key, NULL::BIGINT AS ordinal, {unwrap('v')} AS v FROM roots WHERE v IS NOT NULL
            UNION ALL SELECT rec_no, field, cell, CASE WHEN path IS NULL THEN coalesce(x.k, x.o::VARCHAR) ELSE path || '/' || coalesce(x.k, x.o::VARCHAR) END, list_append(ords, x.o), x.k, label, CASE WHEN len(ords) = 0 THEN x.k ELSE key END, x.o, {unwrap('x.c')}
            FROM (SELECT rec_no, field, cell, path, ords, label, key, unnest({parts}) AS x FROM n WHERE json_type(v) IN ('OBJECT', 'ARRAY'))),
        m AS (SELECT rec_no, field, cell, coalesce(path, '') AS path, ords, len(ords) AS depth, label, above, key, ordinal, {kind} AS kind, CASE WHEN json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string(v, '$') END AS scalar, row_number() OVER (PARTITION BY rec_no, field, cell ORDER BY ords) - 1 AS node FROM n),
        w AS (SELECT c.*, p.node AS parent, t.node AS top, r.kind AS root_kind FROM m c LEFT JOIN m p ON p.rec_no = c.rec_no AND p.field = c.field AND p.cell = c.cell AND c.depth > 0 AND p.ords = c.ords[:-2]
            LEFT JOIN m t ON t.rec_no = c.rec_no AND t.field = c.field AND t.cell = c.cell AND c.depth > 0 AND t.ords = c.ords[1:1] JOIN m r ON r.rec_no = c.rec_no AND r.field = c.field AND r.cell = c.cell AND r.depth = 0),
        s AS (SELECT rec_no, field, cell, parent AS node, map_from_entries(list(struct_pack(k := label, v := scalar)) FILTER (WHERE label IS NOT NULL)) AS named,
            string_agg(ordinal || ':' || coalesce(label, '') || ':' || kind || ':' || scalar, '|' ORDER BY ordinal) AS scalars FROM w WHERE scalar IS NOT NULL AND parent IS NOT NULL GROUP BY ALL)"""
    ids = "w.rec_no, w.field, w.cell, w.node, w.parent"
    joined = "w LEFT JOIN s ON s.rec_no = w.rec_no AND s.field = w.field AND s.cell = w.cell AND s.node = w.node"
    get = lambda *xs: ", ".join(f'named[{q(x)}] AS "{x}"' for x in xs)
    item = "w.field <> 'rule_evaluate_dict' AND (root_kind = 'object' AND (depth = 2 AND label IS NULL OR depth = 1 AND scalar IS NOT NULL OR depth = 3 AND above = 'items') OR root_kind = 'array' AND depth = 1)"
    return {
        "p2_found": f"{base} SELECT rec_no, field, path FROM m WHERE scalar IS NOT NULL",
        "p2_cells": f"{base} SELECT rec_no, field, cell, node, kind FROM m WHERE depth = 0",
        "p2_categories": f"{base} SELECT {ids}, label, ordinal, kind, path, {get('weight')}, scalars FROM {joined} WHERE w.field <> 'rule_evaluate_dict' AND root_kind = 'object' AND depth = 1 AND scalar IS NULL",
        "p2_constraints": f"""{base}, tw AS (SELECT rec_no, field, cell, top, max(scalar) AS of_top FROM w WHERE depth = 2 AND label = 'weight' AND scalar IS NOT NULL GROUP BY ALL)
            SELECT {ids}, ordinal, coalesce(named['type'], named['constraint_type'], key) AS category, coalesce(scalar, named['text'], named['description']) AS body, coalesce(named['weight'], of_top) AS weight, scalars, path
            FROM {joined} LEFT JOIN tw ON tw.rec_no = w.rec_no AND tw.field = w.field AND tw.cell = w.cell AND tw.top = w.top WHERE {item}""",
        "p2_rules": f"{base} SELECT {ids}, ordinal, label AS rule, kind, scalar, path, scalars FROM {joined} WHERE w.field = 'rule_evaluate_dict' AND depth = 1 AND kind <> 'null'",
        "p2_parts": f"{base} SELECT {ids}, label, ordinal, kind, path, {get('word', 'count', 'model', 'name', 'ok', 'tool', 'round', 'by', 'weight', 'min', 'max')}, scalars FROM {joined} WHERE kind IN ('object', 'array') AND depth >= 2",
        "p2_values": f"{base} SELECT {ids}, label, ordinal, kind, scalar, path FROM w WHERE scalar IS NOT NULL",
    }


def _rules() -> dict[str, str]:
    v = "CASE WHEN json_valid(rule_evaluate_dict) THEN rule_evaluate_dict::JSON END"
    pair = "json_extract(v, '$.word_length.func_input[1]')"
    text = lambda k: f"CASE WHEN json_type(v, '$.{k}.func_input[1]') = 'VARCHAR' THEN json_extract_string(v, '$.{k}.func_input[1]') END"
    body = trim_ws("response")
    base = f"""WITH a AS (SELECT rec_no, {v} AS v FROM constraint_records),
        b AS (SELECT rec_no, v, {pair} AS pair, TRY_CAST(json_extract_string(v, '$.word_length.func_input[2]') AS INTEGER) AS tgt,
            CASE WHEN json_type(v, '$.keyword.func_input[1]') = 'OBJECT' THEN json_extract(v, '$.keyword.func_input[1]') END AS kw,
            coalesce({', '.join(f"json_extract_string(v, '$.{k}.func_input[0]')" for k in ('word_length', 'keyword', 'start_with', 'end_with'))}, '') AS response FROM a),
        p AS (SELECT rec_no, response, kw, CASE WHEN json_type(pair) = 'ARRAY' AND json_array_length(pair) = 2 THEN TRY_CAST(json_extract_string(pair, '$[0]') AS INTEGER) WHEN tgt IS NOT NULL THEN greatest(1, floor(tgt * 0.8::DOUBLE)::INTEGER) END AS lo,
            CASE WHEN json_type(pair) = 'ARRAY' AND json_array_length(pair) = 2 THEN TRY_CAST(json_extract_string(pair, '$[1]') AS INTEGER) WHEN tgt IS NOT NULL THEN floor(tgt * 1.2::DOUBLE)::INTEGER END AS hi, {text('start_with')} AS s, {text('end_with')} AS e FROM b),
        k AS (SELECT *, list_transform(json_keys(kw), lambda x: struct_pack(k := x, n := TRY_CAST(json_extract_string(kw, '$."' || x || '"') AS INTEGER))) AS ks FROM p),
        r AS (SELECT rec_no, response, lo, hi, ks, s, e, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN len({words('response')}) BETWEEN lo AND hi END AS "length",
            CASE WHEN len(ks) > 0 THEN len(list_filter(ks, lambda x: ({count_in('lower(response)', 'lower(x.k)')}) < x.n)) = 0 END AS keyword,
            CASE WHEN s IS NOT NULL THEN starts_with(lower({body}), lower({trim_ws('s')})) END AS "start", CASE WHEN e IS NOT NULL THEN ends_with(lower({body}), lower({trim_ws('e')})) END AS "end" FROM k),
        t AS (SELECT *, coalesce("length"::INT, 0) + coalesce(keyword::INT, 0) + coalesce("start"::INT, 0) + coalesce("end"::INT, 0) AS n_ok,
            ("length" IS NOT NULL)::INT + (keyword IS NOT NULL)::INT + ("start" IS NOT NULL)::INT + ("end" IS NOT NULL)::INT AS n FROM r)"""
    score = lambda other: f"CASE WHEN n > 0 THEN n_ok::DOUBLE / n ELSE {other} END"
    return {
        "rule_parse": f"""{base} SELECT rec_no, lo::BIGINT AS lo, hi::BIGINT AS hi, array_to_string(list_sort(list_transform(ks, lambda x: x.k || '=' || x.n)), '|') AS keywords, s AS "start", e AS "end" FROM t""",
        "rule_scores": f"""{base} SELECT rec_no, "length", keyword, "start", "end", {score('0.0')} AS score, 1 - {score('0.0')} AS loss FROM t""",
        "train_scores": f"""{base} SELECT rec_no, "length"::INT::DOUBLE AS length_score, keyword::INT::DOUBLE AS keyword_score, "start"::INT::DOUBLE AS start_score, "end"::INT::DOUBLE AS end_score, {score('1.0')} AS score FROM t""",
        **_judge(base),
    }


def _judge(base: str) -> dict[str, str]:
    keys = ("length", "keyword", "start_with", "end_with", "style", "topic")
    cell = "added_constraint_from_llm"
    of = lambda n: f"CASE WHEN list_contains(json_keys(j), '{n}') THEN json_extract(j, '$.{n}') ELSE json_extract(j, '$.{n.lower()}') END"
    texts = lambda x: f"CASE json_type({x}) WHEN 'VARCHAR' THEN [json_extract_string({x}, '$')] WHEN 'ARRAY' THEN list_transform(list_filter(json_extract({x}, '$[*]'), lambda i: json_type(i) = 'VARCHAR'), lambda i: json_extract_string(i, '$')) END"
    some = lambda xs: f"CASE WHEN len({xs}) > 0 THEN {xs} END"
    quoted = lambda xs: f"array_to_string(list_transform({xs}, lambda x: '\"' || x || '\"'), ', ')"
    words = "array_to_string(list_transform(list_sort(ks), lambda x: '\"' || x.k || '\" ' || x.n || ' times or more'), ' and ')"
    line = {
        "length": ("lo IS NOT NULL AND hi IS NOT NULL", "'from ' || lo || ' to ' || hi || ' words'"), "keyword": ("len(ks) > 0", f"'contains ' || {words}"),
        "start_with": ("s <> ''", "'begins with \"' || s || '\"'"), "end_with": ("e <> ''", "'ends with \"' || e || '\"'"),
        "style": ("styles IS NOT NULL", f"'its style is all of ' || {quoted('styles')}"), "topic": ("topics IS NOT NULL", f"'its topic is all of ' || {quoted('topics')}"),
    }
    listed_keys = "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{k}' END" for k, (cond, _) in line.items()) + "], lambda k: k IS NOT NULL)"
    lines = "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '- {k}: ' || {text} END" for k, (cond, text) in line.items()) + "], lambda x: x IS NOT NULL)"
    asked = f"""{base}, c1 AS (SELECT rec_no, CASE WHEN json_valid({cell}) THEN {cell}::JSON END AS j FROM constraint_records),
        c2 AS (SELECT rec_no, {of('Style')} AS sx, {of('Topic')} AS tx FROM c1), c3 AS (SELECT rec_no, {texts('sx')} AS sl, {texts('tx')} AS tl FROM c2),
        d AS (SELECT t.*, {some('sl')} AS styles, {some('tl')} AS topics FROM t JOIN c3 USING (rec_no)),
        qk AS (SELECT *, {listed_keys} AS keys, {lines} AS lines FROM d),
        qq AS (SELECT *, CASE WHEN len(keys) > 0 THEN 'Answer:' || chr(10) || response || chr(10) || chr(10) || 'Does the answer meet each of these?' || chr(10) || array_to_string(lines, chr(10)) || chr(10) || chr(10) || 'Reply with JSON only: {{' || array_to_string(list_transform(keys, lambda k: '"' || k || '": 0 or 1'), ', ') || '}}' END AS question FROM qk),
        j AS (SELECT *, question IS NOT NULL AND length(question) % 5 <> 0 AS ok, {', '.join(f"CASE WHEN question IS NOT NULL AND length(question) % 5 <> 0 AND list_contains(keys, '{k}') THEN (length(question) + {len(k)}) % 2 END::BIGINT AS j_{k}" for k in keys)} FROM qq)"""
    ruled = {"length": '"length"', "keyword": "keyword", "start_with": '"start"', "end_with": '"end"'}

    def scored(use: str, otherwise: str) -> str:
        one = ", ".join(f"CASE WHEN {use} THEN j_{k} ELSE {ruled[k] + '::INT' if k in ruled else 'NULL'} END::BIGINT AS v_{k}" for k in keys)
        total = " + ".join(f"(v_{k} IS NOT NULL)::INT" for k in keys)
        passed = " + ".join(f"coalesce(v_{k}, 0)" for k in keys)
        score = f"CASE WHEN ({total}) > 0 THEN ({passed})::DOUBLE / ({total}) ELSE 0.0 END"
        return f"""{asked}, z AS (SELECT rec_no, CASE WHEN {use} THEN 'judge' ELSE '{otherwise}' END AS scorer, {one} FROM j)
            SELECT rec_no, {', '.join(f'v_{k} AS "{k}"' for k in keys)}, ({passed})::BIGINT AS passed, ({total})::BIGINT AS total, {score} AS score, round(1 - {score}, 6) AS loss, scorer FROM z"""

    return {
        "parse_style_topic": f"{asked} SELECT rec_no, array_to_string(styles, '|') AS styles, array_to_string(topics, '|') AS topics FROM d",
        "judge_prompt": f"{asked} SELECT rec_no, question FROM qq",
        "batch_judge": f"{asked} SELECT rec_no, {', '.join(f'j_{k} AS "{k}"' for k in keys)} FROM j",
        "judge_fallback": scored("ok", "rule(fallback)"),
        "rule_scorer": scored("false", "rule"),
    }


def _validators() -> dict[str, str]:
    texts = lambda *ns: "list_filter(coalesce(" + ", ".join(f"added_constraint[{q(n)}]" for n in ns) + ", []), lambda c: c IS NOT NULL)"
    r = "response_of_winner_prompt"
    low = f"lower({r})"
    quoted = '["“”]([^"]+)["“”]'
    times = quoted + r".*?(\d+)\s*[tT][iI][mM][eE][sS]"
    nums = lambda c: f"list_transform(regexp_extract_all({c}, '[0-9]+'), lambda n: n::BIGINT)"
    phrases = lambda *ns: f"list_transform(list_filter({texts(*ns)}, lambda c: regexp_matches(c, {q(quoted)})), lambda c: lower({trim_ws(f'regexp_extract(c, {q(quoted)}, 1)')}))"
    none = lambda xs, bad: f"len(list_filter({xs}, lambda c: {bad})) = 0"
    wc, sc = f"len({words(r)})", pieces(r)
    nine = {
        "length_ok": none(texts("Length"), f"len({nums('c')}) >= 2 AND contains(lower(c), 'word') AND NOT ({wc} BETWEEN ({nums('c')})[1] AND ({nums('c')})[2])") + " AND " + none(texts("Length"), f"len({nums('c')}) >= 1 AND contains(lower(c), 'sentence') AND {sc} > ({nums('c')})[1]"),
        "keyword_ok": none(texts("Keyword"), f"regexp_matches(c, {q(times)}) AND ({count_in(low, f'lower(regexp_extract(c, {q(times)}, 1))')}) < TRY_CAST(regexp_extract(c, {q(times)}, 2) AS BIGINT)"),
        "start_ok": none(phrases("Strat_With", "Start_With"), f"coalesce(({words(low)})[1], '') <> c"),
        "end_ok": none(phrases("End_With"), f"coalesce(regexp_extract_all({low}, {ANYWORD})[-1], '') <> c"),
        "format_ok": f"({none(texts('Format'), 'contains(c, ' + q('<<') + ')')}) OR regexp_matches({r}, '<<.+?>>')",
        "tone_ok": "NOT (" + " OR ".join(f"contains({low}, {q(w)})" for w in K.INFORMAL) + ")",
        "style_ok": "true", "role_ok": "true", "numerical_ok": "true",
    }
    cv = f"WITH n AS (SELECT line_no, {', '.join(f'({s}) AS {k}' for k, s in nine.items())} FROM instruction_records WHERE {r} IS NOT NULL) SELECT *, ({' + '.join(f'{k}::INT' for k in nine)})::DOUBLE / 9 AS csr FROM n"

    dquoted = '["“”]([^"“”]+)["“”]'
    dtimes = dquoted + r".*?(\d+)\s*[tT][iI][mM][eE][sS]"
    rx = lambda p, g: f"regexp_extract(d, {q(p)}, {g})"
    n0, n1 = "ns[1]", "ns[2]"
    by_words = f"CASE WHEN {n1} IS NOT NULL THEN wc BETWEEN {n0} AND {n1} WHEN contains(ld, 'at least') OR contains(ld, 'minimum') OR contains(ld, 'more than') THEN wc >= {n0} ELSE wc <= {n0} END"
    length = f"coalesce(CASE WHEN contains(ld, 'word') AND {n0} IS NOT NULL THEN {by_words} END, true) AND coalesce(CASE WHEN contains(ld, 'sentence') AND {n0} IS NOT NULL THEN sc <= {n0} END, true)"
    keyword = f"CASE WHEN regexp_matches(d, {q(dquoted)}) THEN ({count_in('lr', 'kw')}) >= coalesce(TRY_CAST({rx(dtimes, 2)} AS BIGINT), 1) ELSE true END"
    start = f"CASE WHEN ph <> '' THEN ({words('lr')})[1:len({words('ph')})] = {words('ph')} ELSE true END"
    toks = lambda x: f"regexp_extract_all({x}, {ANYWORD})"
    end = f"CASE WHEN len({toks('ph')}) > 0 THEN ({toks('lr')})[greatest(1, len({toks('lr')}) - len({toks('ph')}) + 1):] = {toks('ph')} ELSE true END"
    fmt = f"NOT contains(ld, '<<') OR regexp_matches(response, '<<.+?>>')"
    tag = "CASE " + " ".join(f"WHEN contains(lk, '{t}') THEN '{t}'" for t in ("length", "keyword", "start", "end", "format", "tone", "style", "role", "numerical")) + " ELSE 'other' END"
    field = lambda n: f"CASE WHEN json_type(i, '$.{n}') = 'VARCHAR' THEN json_extract_string(i, '$.{n}') END"
    desc = f"""WITH a0 AS (SELECT rec_no, id, CASE WHEN json_valid(added_constraint) THEN added_constraint::JSON END AS v FROM constraint_records),
        a1 AS (SELECT rec_no, id, CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(json_extract_string(v, '$')) THEN json_extract_string(v, '$')::JSON ELSE v END AS v FROM a0),
        c AS (SELECT rec_no, id, list_transform(json_extract(v, '$[*]'), lambda i: struct_pack("type" := {field('type')}, constraint_type := {field('constraint_type')}, description := {field('description')})) AS cs FROM a1 WHERE json_type(v) = 'ARRAY'),
        f AS (SELECT id, coalesce({r}, '') AS response FROM instruction_records WHERE line_no IN (SELECT min(line_no) FROM instruction_records GROUP BY id)),
        x AS (SELECT rec_no, response, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS pos FROM c JOIN f USING (id)),
        y AS (SELECT rec_no, pos::BIGINT AS pos, response, lower(response) AS lr, lower(coalesce(nullif(c.type, ''), c.constraint_type, '')) AS lk, coalesce(c.description, '') AS d FROM x),
        z AS (SELECT *, lower(d) AS ld, list_transform(regexp_extract_all(lower(d), '[0-9]+'), lambda n: n::BIGINT) AS ns, len({words('response')}) AS wc, {pieces('response')} AS sc,
            lower({trim_ws(f"coalesce(nullif({rx(dtimes, 1)}, ''), {rx(dquoted, 1)})")}) AS kw, lower({trim_ws(rx(dquoted, 1))}) AS ph FROM y),
        s AS (SELECT rec_no, pos, {tag} AS tag, CASE WHEN (CASE WHEN contains(lk, 'length') THEN {length} WHEN contains(lk, 'keyword') THEN {keyword} WHEN contains(lk, 'start') THEN {start} WHEN contains(lk, 'end') THEN {end} WHEN contains(lk, 'format') THEN {fmt} ELSE true END) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM z)"""
    return {"cv_validators": cv, "desc_validators": f"{desc} SELECT * FROM s", "desc_record_means": f"{desc}, g AS (SELECT rec_no, count(*) AS n, sum(score::INT)::DOUBLE / count(*) AS m FROM s GROUP BY rec_no) SELECT c.rec_no, coalesce(n, 0)::BIGINT AS n_rules, coalesce(m, 1.0) AS mean_score FROM c JOIN f USING (id) LEFT JOIN g USING (rec_no)",
        "desc_overall": f"{desc}, g AS (SELECT rec_no, sum(score::INT)::DOUBLE / count(*) AS m FROM s GROUP BY rec_no) SELECT count(*) AS n_records, round(avg(coalesce(m, 1.0)), 9) AS csr FROM c JOIN f USING (id) LEFT JOIN g USING (rec_no)",
        "desc_means": f"{desc} SELECT tag, count(*) AS n, sum(score::INT)::DOUBLE / count(*) AS mean_score FROM s GROUP BY tag"}


def _tags() -> dict[str, str]:
    counts = f"""WITH u AS (SELECT line_no, unnest(map_entries(added_constraint)) AS e FROM instruction_records),
        n AS (SELECT line_no, {category('e.key')} AS category, sum(CASE WHEN e.value IS NULL THEN 1 ELSE len(e.value) END)::BIGINT AS n FROM u GROUP BY ALL)"""
    assign = f"""{counts}, t AS (SELECT line_no, list_sort(list(category)) AS cats, max(n) AS top, list(n) AS ns, max_by(category, n) AS lead FROM n GROUP BY line_no),
        a AS (SELECT r.line_no, r.added_constraint_num, CASE WHEN cats IS NULL THEN ['unconstrained'] ELSE cats END AS cats, CASE WHEN cats IS NULL THEN 1 ELSE len(cats) END::BIGINT AS num_constraint_types,
            CASE WHEN cats IS NULL THEN 'unconstrained' WHEN len(list_filter(ns, lambda x: x = top)) = 1 THEN lead ELSE 'mixed' END AS primary_cluster FROM instruction_records r LEFT JOIN t USING (line_no)),
        b AS (SELECT *, array_to_string(cats, '+') AS cluster_label FROM a)"""
    share = lambda c: f"{assign}, g AS (SELECT {c}, count(*) AS n FROM b GROUP BY {c}) SELECT {c}, n, n::DOUBLE / (SELECT sum(n) FROM g)::DOUBLE AS share FROM g"
    return {
        "constraint_counts": f"{counts} SELECT * FROM n",
        "assign_clusters": f"{assign} SELECT line_no, array_to_string(cats, '|') AS categories, num_constraint_types, primary_cluster, cluster_label FROM b",
        "cluster_summary": share("primary_cluster"),
        "type_count_dist": share("num_constraint_types"),
        "top_labels": f"{assign} SELECT cluster_label, count(*) AS n, min(line_no) AS first_seen FROM b GROUP BY cluster_label ORDER BY n DESC, first_seen LIMIT 20",
        "category_presence": f"{assign} SELECT category, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM b) AS share FROM (SELECT unnest(cats) AS category FROM b) GROUP BY category",
        "cluster_report": f"""{assign}, i AS (SELECT 'by_primary_cluster' AS section, primary_cluster AS value, line_no FROM b UNION ALL SELECT 'num_constraint_types', num_constraint_types::VARCHAR, line_no FROM b
            UNION ALL SELECT 'category_presence', unnest(cats), line_no FROM b UNION ALL SELECT 'top_cluster_labels', cluster_label, line_no FROM b),
            k AS (SELECT section, value, count(*) AS n, min(line_no) AS first_seen FROM i GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, first_seen) AS place FROM k)
            SELECT section, value, n, round(100 * n::DOUBLE / (SELECT count(*) FROM b), 2) AS pct FROM r WHERE section <> 'top_cluster_labels' OR place <= 20""",
        "level_by_cluster": f"{assign} SELECT primary_cluster, {level('added_constraint_num')} AS level, count(*) AS n FROM b GROUP BY ALL",
    }


def _folds() -> dict[str, str]:
    names = "length_ok sentence_ok keyword_ok start_ok end_ok format_ok tone_ok style_ok role_ok".split()
    means = "WITH l AS (" + " UNION ALL ".join(f"SELECT model, fold, '{n}' AS metric, {n}::INT AS v FROM cv_scores" for n in names) + "), m AS (SELECT model, fold, metric, sum(v)::DOUBLE / count(v) AS value FROM l GROUP BY ALL)"
    summary = lambda std: f"{means} SELECT model, metric, round(avg(value), 9) AS mean, round({std}(value), 9) AS std, count(value) AS n_folds FROM m GROUP BY ALL"
    rates = " UNION ALL ".join(f"SELECT '{n}' AS key, count({n}) AS n, sum({n}::INT)::DOUBLE / count({n}) AS pass_rate, 1 - sum({n}::INT)::DOUBLE / count({n}) AS loss FROM cv_scores HAVING count({n}) > 0" for n in names)
    with_csr = means.replace("WITH l AS (", "WITH l AS (SELECT model, fold, 'csr' AS metric, csr AS v FROM cv_scores UNION ALL ").replace("::INT AS v", "::INT::DOUBLE AS v")
    compare = f"""{with_csr}, a AS (SELECT model, metric, avg(value) AS mean FROM m GROUP BY ALL), w AS (SELECT metric, max(mean) FILTER (WHERE model = 'lora') AS a, max(mean) FILTER (WHERE model = 'full_ft') AS b FROM a GROUP BY metric)
        SELECT metric, round(a, 9) AS mean_a, round(b, 9) AS mean_b, CASE WHEN a > b THEN 'lora' WHEN b > a THEN 'full_ft' ELSE 'Tie' END AS winner FROM w"""
    return {"per_key_rates": rates, "fold_means": f"{means} SELECT * FROM m", "fold_summary": summary("stddev_samp"), "fold_summary_pop": summary("stddev_pop"), "model_compare": compare, "model_wins": f"SELECT winner, count(*) AS n_metrics FROM ({compare}) GROUP BY winner"}


def _levels(rows: str) -> str:
    used = f"(SELECT * FROM ({rows}) WHERE num_checked > 0)"
    one = lambda name, cond: f"SELECT '{name}' AS level, count(*)::BIGINT AS n, coalesce(sum(per_constraint_csr::DECIMAL(18, 9))::DOUBLE / nullif(count(*), 0), 0.0) AS mean_csr, coalesce(count(*) FILTER (WHERE hard_csr)::DOUBLE / nullif(count(*), 0), 0.0) AS hard_csr FROM {used} WHERE {cond}"
    return " UNION ALL ".join([*(one(x, f"difficulty_level = '{x}'") for x in ("L1", "L2", "L3", "L4")), one("Overall", "true")])


MERGED = "SELECT resp_id, model, difficulty_level, num_checked, CASE WHEN num_checked > num_passed THEN num_checked ELSE num_passed END AS num_passed, CASE WHEN num_checked > num_passed THEN 1.0 ELSE per_constraint_csr END AS per_constraint_csr, CASE WHEN num_checked > num_passed THEN true ELSE hard_csr END AS hard_csr FROM model_responses"


def _samples() -> dict[str, str]:
    h = lambda k: f"sha256('42:' || {k}::VARCHAR)"
    return {
        "stable_shuffle": f"SELECT row_no, row_number() OVER (ORDER BY {h('row_no')}, row_no) AS position FROM cv_records",
        "kfold_assign": f"SELECT row_no, ntile(5) OVER (ORDER BY {h('row_no')}, row_no) AS fold FROM cv_records",
        "fold_sample": f"SELECT row_no, fold FROM (SELECT row_no, fold, row_number() OVER (PARTITION BY fold ORDER BY {h('row_no')}, row_no) AS rn FROM cv_records) WHERE rn <= 20",
        "stratified_sample": f"SELECT id, difficulty_level FROM (SELECT id, difficulty_level, row_number() OVER (PARTITION BY difficulty_level ORDER BY {h('id')}, id) AS rn FROM eval_prompts) WHERE rn <= (SELECT greatest(1, 100 // count(DISTINCT coalesce(difficulty_level, ''))) FROM eval_prompts)",
        "holdout_split": f"SELECT row_no, CASE WHEN rn <= n - floor(n * 0.1::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM (SELECT row_no, row_number() OVER (ORDER BY {h('row_no')}, row_no) AS rn, count(*) OVER () AS n FROM cv_records)",
        "head_sample": "SELECT line_no, id FROM instruction_records ORDER BY line_no LIMIT 100",
    }


def _augmented() -> dict[str, str]:
    p, m = "winner_prompt", "added_constraint"
    draw = "('0x' || substr(sha256('42:' || line_no::VARCHAR || ':' || (i - 1)::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    deletion = f"""WITH a AS (SELECT line_no, {words(p)} AS ws, {protected(p, m)} AS guard FROM instruction_records WHERE {p} IS NOT NULL),
        b AS (SELECT line_no, ws, list_filter(range(1, len(ws) + 1), lambda i: list_contains(guard, lower(ws[i])) OR list_contains(guard, lower(trim(ws[i], {q(K.EDGE)}))) OR {draw} >= 0.1) AS left_over FROM a)
        SELECT line_no, array_to_string(CASE WHEN len(left_over) > 0 THEN list_transform(left_over, lambda i: ws[i]) ELSE ws[1:1] END, ' ') AS prompt FROM b"""
    kept = lambda c: f"len(list_filter({constrained(p, m)}, lambda t: NOT contains(lower({c}), lower(t)))) = 0"
    rows = f"FROM instruction_records WHERE {p} IS NOT NULL"
    return {
        "random_deletion": deletion,
        "bt_verify": f"SELECT line_no, {kept(f'replace({p}, {q("the")}, {q("THIS")})')} AS preserved {rows}",
        "augment_union": f"SELECT line_no, 0::BIGINT AS aug_rank, id, augmentation_method, NULL::VARCHAR AS augmentation_intermediate_lang {rows} UNION ALL SELECT line_no, 1, id || '_lex', 'lexical', NULL {rows} UNION ALL SELECT line_no, 2, id || '_bt', 'back_translation', 'xx' {rows}",
        "aug_stats": f"SELECT 'lexical' AS augmentation_method, count(*) AS total, count(*) AS augmented, 0::BIGINT AS fell_back, 0::BIGINT AS errors {rows} UNION ALL SELECT 'back_translation', count(*), count(*) FILTER (WHERE ok), count(*) FILTER (WHERE NOT ok), 0 FROM (SELECT {trim_ws(p)} <> '' AND {kept(f'upper({p})')} AS ok {rows})",
        "back_translate": f"SELECT line_no, CASE WHEN {trim_ws(p)} = '' THEN {p} ELSE '<' || {p} || '>!' END AS out {rows}",
    }


def oracle_sql() -> dict[str, str]:
    docs = lambda f: f"SELECT doc_id, {f('text')} AS out FROM documents"
    recs = lambda f: f"SELECT line_no, {f('winner_prompt')} AS out FROM instruction_records"
    both = ("winner_prompt", "response_of_winner_prompt")
    strange = lambda c: f"regexp_extract_all(coalesce({c}, ''), '[^\\x{{0}}-\\x{{7F}}]')"
    mined = lambda c: "array_to_string(list_transform(flatten([" + ", ".join(captured(c, p) for p in K.MINED) + "]), lambda m: 'parsed_from_prompt=' || m), '|')"
    counts = "SELECT category, count(*) AS n_records FROM (SELECT unnest(CASE WHEN cardinality(added_constraint) > 0 THEN map_keys(added_constraint) ELSE ['unknown'] END) AS category FROM instruction_records) GROUP BY category"
    turn = lambda role, t: f"'<|start_header_id|>{role}<|end_header_id|>' || chr(10) || chr(10) || {t} || '<|eot_id|>'"
    llama = f"'<|begin_of_text|>' || {turn('system', q('Be brief.'))} || {turn('user', 'winner_prompt')} || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)"
    wc = lambda c: f"len({words(c)})"
    lengths = " UNION ALL ".join(f"SELECT '{c}' AS field, min(n)::BIGINT AS min_words, trunc(median(n))::BIGINT AS median_words, sum(n)::DOUBLE / count(n) AS mean_words, max(n)::BIGINT AS max_words FROM (SELECT {wc(c)} AS n FROM instruction_records) WHERE n > 0" for c in both)
    covered = "id source winner_prompt prompt_lang response_winner response_of_winner_prompt response_lang augmentation_method".split()
    pairs = """WITH t AS (SELECT row_no, winner_prompt AS t FROM cv_records WHERE length(winner_prompt) > 0),
        s AS (SELECT DISTINCT row_no, unnest(CASE WHEN length(t) < 5 THEN [t] ELSE list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)) END) AS g FROM t),
        n AS (SELECT row_no, count(*) AS n FROM s GROUP BY row_no), i AS (SELECT a.row_no AS a, b.row_no AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.row_no < b.row_no GROUP BY ALL)
        SELECT a, b, k::DOUBLE / (x.n + y.n - k) AS similarity FROM i JOIN n x ON x.row_no = a JOIN n y ON y.row_no = b WHERE k::DOUBLE / (x.n + y.n - k) >= 0.85"""
    cell = "added_constraint"
    shape = f"""WITH a AS (SELECT rec_no, CASE WHEN json_valid({cell}) THEN {cell}::JSON END AS v FROM constraint_records),
        e AS (SELECT rec_no, v, json_type(v) AS t, CASE WHEN json_type(v) = 'OBJECT' THEN list_transform(json_keys(v), lambda k: json_extract(v, '$."' || k || '"')) END AS cs FROM a),
        f AS (SELECT rec_no, t, cs, CASE WHEN len(list_filter(cs, lambda c: json_type(c) <> 'ARRAY')) = 0 THEN flatten(list_transform(cs, lambda c: json_extract(c, '$[*]'))) END AS items FROM e)
        SELECT rec_no, CASE WHEN t IS NULL OR t = 'NULL' OR len(cs) = 0 THEN 'missing' WHEN t <> 'OBJECT' THEN 'not_object' WHEN items IS NULL OR len(list_filter(cs, lambda c: json_array_length(c) = 0)) > 0 THEN 'bad_category'
            WHEN len(list_filter(items, lambda i: json_type(i) <> 'VARCHAR' OR {trim_ws("json_extract_string(i, '$')")} = '')) > 0 THEN 'blank_item' END AS reason FROM f"""
    undetected = f"CASE {GATES} ELSE 'kept' END"
    opened = """WITH x AS (SELECT resp_id, list_transform(coalesce(results, []), lambda r: coalesce(r.passed, length(response) % 2 = 0)) AS ps FROM model_responses WHERE response IS NOT NULL)
        SELECT resp_id, len(ps)::BIGINT AS num_constraints, len(ps)::BIGINT AS num_checked, len(list_filter(ps, lambda p: p))::BIGINT AS num_passed, len(ps) > 0 AND len(list_filter(ps, lambda p: p)) = len(ps) AS hard_csr FROM x"""
    return {
        **_shredded(),
        "remove_html": docs(html), "replace_emojis": docs(emojis), "replace_unknown_chars": recs(unknown), "normalize_symbols": recs(symbols), "normalize_whitespace": docs(spaces), "clean_text": docs(clean),
        "remove_stopwords": docs(stopless), "fingerprint": docs(finger), "printable_ratio": docs(printable), "entities": recs(lambda c: listed(entities(c))), "mine_constraints": recs(mined),
        "safe_names": "SELECT line_no, translate(source, '/-', '__') AS out FROM instruction_records",
        "chat_template": f"SELECT line_no, {llama} || 'User: ' || winner_prompt || chr(10) || 'Assistant:' AS out FROM instruction_records",
        "shingles": "SELECT line_no, len(s)::BIGINT AS n_shingles, list_sort(s)[1] AS first_shingle FROM (SELECT line_no, list_distinct(CASE WHEN length(winner_prompt) < 5 THEN [winner_prompt] ELSE list_transform(range(1, length(winner_prompt) - 3), lambda i: substr(winner_prompt, i, 5)) END) AS s FROM instruction_records)",
        "word_counts": f"SELECT doc_id, {wc('text')}::BIGINT AS n_words, {parts('text', '[.!?]+')}::BIGINT AS n_sentences, {pieces('text')}::BIGINT AS n_pieces, {parts('text', chr(92) + 'n' + chr(92) + 'n+')}::BIGINT AS n_paragraphs FROM documents WHERE text IS NOT NULL",
        "normalise_category": f"SELECT DISTINCT raw, {category('raw')} AS category FROM (SELECT unnest(map_keys(added_constraint)) AS raw FROM instruction_records)",
        "protected_tokens": f"SELECT line_no, {listed(protected('winner_prompt', 'added_constraint'))} AS tokens FROM instruction_records WHERE winner_prompt IS NOT NULL",
        "constraint_tokens": f"SELECT line_no, {listed(constrained('winner_prompt', 'added_constraint'))} AS tokens FROM instruction_records WHERE winner_prompt IS NOT NULL",
        "parse_judge": "SELECT score_id, CASE WHEN score_id % 4 > 1 THEN style_ok::INT END AS style, CASE WHEN score_id % 4 > 1 THEN tone_ok::INT END AS topic FROM cv_scores",
        "parse_verdict": "SELECT score_id, CASE score_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS passed FROM cv_scores",
        "alias_projection": f"SELECT line_no, coalesce(nullif(winner_prompt, ''), nullif(prompt_winner, ''), '') AS prompt, coalesce(nullif(response_of_winner_prompt, ''), nullif(response_winner, ''), '') AS response, {level('coalesce(added_constraint_num, 0)')} AS difficulty, coalesce(id, line_no::VARCHAR) AS key FROM instruction_records",
        "quality_gates": f"{GATED} SELECT line_no, len({words('p')}) >= 15 AS long_enough, {printable('p')} >= 0.85 AS printable, {trim_ws('r')} <> '' AS answered FROM g",
        "language_gate": f"SELECT line_no, NOT coalesce({detected('prompt_lang')} <> 'en', false) AS kept FROM instruction_records",
        "constraint_integrity": f"SELECT line_no, {integrity('added_constraint', 'added_constraint_num')} AS reason FROM instruction_records",
        "constraint_integrity_json": shape,
        "difficulty_levels": f"SELECT line_no, {level('added_constraint_num')} AS level FROM instruction_records",
        "relation_compare": f"WITH c AS (SELECT id, {wc('winner_prompt')} AS n, unnest(constraints) AS c, generate_subscripts(constraints, 1) - 1 AS pos FROM eval_prompts) SELECT id, pos::BIGINT AS pos, {compared('n', 'c.target', 'c.relation')} AS met FROM c",
        "sft_filter": f"SELECT line_no FROM instruction_records WHERE {wc('coalesce(winner_prompt, ' + q('') + ')')} < 60 AND {wc('coalesce(response_of_winner_prompt, ' + q('') + ')')} > 0",
        "needs_judging": "SELECT resp_id FROM model_responses WHERE len(list_filter(results, lambda r: r.passed IS NULL)) > 0",
        "skip_reasons": f"{GATED} SELECT line_no, skip_reason FROM g",
        "skip_funnel": f"{GATED} SELECT count(*) AS total, count(*) FILTER (WHERE skip_reason IS NULL) AS kept, {', '.join(f'count(*) FILTER (WHERE skip_reason = {q(r)}) AS {r}' for r in ('language', 'too_short', 'unprintable', 'empty_response', 'bad_constraint'))} FROM g",
        "preprocess_kept": f"{KEPT} SELECT line_no, p AS prompt, r AS response FROM k WHERE first",
        "preprocess_by_source": f"{KEPT} SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE skip_reason IS NULL) AS n_passed, count(*) FILTER (WHERE first) AS n_kept FROM k GROUP BY source",
        "exact_dedup": f"SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY {finger('text')}) AS kept FROM documents WHERE text IS NOT NULL",
        "near_dup_pairs": pairs,
        "category_counts": counts,
        "imbalance_audit": f"WITH c AS ({counts}), w AS (SELECT sum(n_records)::DOUBLE AS n, count(*) AS k FROM c) SELECT category, n_records, n_records / n AS share, n_records / n < 0.5::DOUBLE / k AS flagged FROM c, w",
        "category_coverage": "SELECT e.key AS category, count(*) AS n_records, sum(len(e.value))::BIGINT AS n_items FROM (SELECT unnest(map_entries(added_constraint)) AS e FROM instruction_records) WHERE len(e.value) > 0 GROUP BY category",
        "field_presence": "SELECT field, count(*) AS n_records FROM (SELECT unnest(list_distinct(json_keys(rule_evaluate_dict))) AS field FROM constraint_records WHERE json_valid(rule_evaluate_dict)) GROUP BY field",
        "field_coverage": " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE {trim_ws(c)} <> '') AS n_filled FROM instruction_records" for c in covered),
        "length_stats": lengths,
        "non_ascii_audit": " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE len({strange(c)}) > 0) AS n_records, sum(len({strange(c)}))::BIGINT AS n_chars FROM instruction_records" for c in both),
        "top_chars": f"SELECT ch, count(*) AS n FROM (SELECT unnest(list_concat({strange(both[0])}, {strange(both[1])})) AS ch FROM instruction_records) GROUP BY ch ORDER BY n DESC, ch LIMIT 20",
        "csr_by_level": _levels("SELECT * FROM model_responses"),
        "pass_by_type": "SELECT r.type AS type, count(*) AS n_checked, count(*) FILTER (WHERE r.passed) AS n_passed, count(*) FILTER (WHERE r.passed)::DOUBLE / count(*) AS pass_rate FROM (SELECT unnest(results) AS r FROM model_responses) WHERE r.passed IS NOT NULL GROUP BY r.type",
        "overall_loss": "SELECT p AS n_passed, c AS n_checked, p::DOUBLE / c AS score, 1 - p::DOUBLE / c AS loss FROM (SELECT sum(num_passed)::BIGINT AS p, sum(num_checked)::BIGINT AS c FROM model_responses)",
        "model_runs": "SELECT model, run_no, count(*) AS n, sum(per_constraint_csr::DECIMAL(18, 9))::DOUBLE / count(per_constraint_csr) AS mean_csr, count(*) FILTER (WHERE hard_csr)::DOUBLE / count(*) AS hard_csr FROM model_responses GROUP BY ALL",
        "training_table": "SELECT line_no, least(400, a + b)::BIGINT AS n_input, a::BIGINT AS n_masked, 1.0::DOUBLE AS constraint_score FROM (SELECT line_no, strlen(coalesce(winner_prompt, '')) AS a, strlen(coalesce(response_of_winner_prompt, '')) AS b FROM instruction_records) WHERE a < least(400, a + b)",
        "constraint_counts_json": f"""WITH a AS (SELECT rec_no, CASE WHEN json_valid({cell}) THEN {cell}::JSON END AS v FROM constraint_records),
            o AS (SELECT rec_no, unnest(list_transform(json_keys(v), lambda k: struct_pack(raw := k, n := CASE WHEN json_type(json_extract(v, '$."' || k || '"')) = 'ARRAY' THEN json_array_length(json_extract(v, '$."' || k || '"'))::BIGINT ELSE 1 END))) AS x FROM a WHERE json_type(v) = 'OBJECT'),
            l AS (SELECT rec_no, unnest(json_extract(v, '$[*]')) AS i FROM a WHERE json_type(v) = 'ARRAY'),
            r AS (SELECT rec_no, x.raw AS raw, x.n AS n FROM o UNION ALL SELECT rec_no, coalesce(nullif(json_extract_string(i, '$.type'), ''), nullif(json_extract_string(i, '$.constraint_type'), ''), CASE WHEN json_type(i) = 'OBJECT' THEN 'other' END, json_extract_string(i, '$')), 1 FROM l)
            SELECT rec_no, {category('raw')} AS category, sum(n)::BIGINT AS n FROM r WHERE raw IS NOT NULL GROUP BY ALL""",
        "constraint_hist": "SELECT difficulty_level, num_constraints, count(*) AS n FROM model_responses GROUP BY ALL",
        "override_merge": f"SELECT resp_id, model, num_passed, per_constraint_csr, hard_csr FROM ({MERGED})",
        "resume_anti_join": "SELECT resp_id, id FROM model_responses WHERE NOT EXISTS (SELECT 1 FROM model_responses d WHERE d.hard_csr AND d.id = model_responses.id)",
        "judge_delta": f"SELECT a.level, a.hard_csr AS rule_hard_csr, b.hard_csr AS judged_hard_csr FROM ({_levels('SELECT * FROM model_responses')}) a JOIN ({_levels(MERGED)}) b USING (level)",
        "judge_open_results": opened, "judge_open_rows": opened,
        "generate": "SELECT resp_id, length(response) || ': ' || substr(response, 1, 20) AS out FROM model_responses",
        "constraint_totals": "SELECT count(*) AS n_records, coalesce(sum(k), 0)::BIGINT AS n_items, coalesce(sum(k), 0)::DOUBLE / greatest(count(*), 1) AS mean_items FROM (SELECT coalesce(list_sum(list_transform(map_values(added_constraint), lambda l: coalesce(len(l), 0))), 0) AS k FROM instruction_records)",
        "preprocess_audit": f"{KEPT}, cc AS (SELECT category, count(*) AS n_records FROM (SELECT unnest(CASE WHEN cardinality(added_constraint) > 0 THEN map_keys(added_constraint) ELSE ['unknown'] END) AS category FROM k WHERE first) GROUP BY category), w AS (SELECT sum(n_records)::DOUBLE AS n, count(*) AS m FROM cc) SELECT category, n_records, n_records / n AS share, n_records / n < 0.5::DOUBLE / m AS flagged FROM cc, w",
        "cc_aliases": f"SELECT resp_id, {wc('response')} >= 50 AS by_count, {wc('response')} >= 50 AS by_value, {wc('response')} >= 50 AS by_num, NULL::BOOLEAN AS by_words, NOT (contains(lower(response), 'kayak') OR contains(lower(response), 'quilt')) AS forbidden FROM model_responses WHERE response IS NOT NULL",
        "stream_skip_counts": f"{GATED}, d AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, {undetected} AS skip_reason FROM c WHERE created_at IS NOT NULL) SELECT day, skip_reason, count(*) AS n FROM d GROUP BY ALL",
        **io_sql(),
        **_check_queries(), **_rules(), **_validators(), **_tags(), **_folds(), **_samples(), **_augmented(),
    }
