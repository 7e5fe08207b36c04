"""DuckDB SQL for the queries of ``ferryline.llm.queries`` that SQL can express."""

from __future__ import annotations

import re

from ferryline.llm import secret_scan
from ferryline.llm.queries import SHORT_CHARS
from ferryline.llm.quality import MAX_REPEATED_PERCENT, MIN_WORDS, RULES, STOP_WORDS, SYMBOLS
from ferryline.llm.token_counts import VERSIONS

ORACLES: dict[str, str] = {}

_WORD = r"[^\x20\x09-\x0D]+"


def _rule_sql() -> str:
    parts = []
    for rule in RULES:
        sides = [f"100 * {rule.part} < {rule.low} * {rule.whole}"] if rule.low is not None else []
        sides += [f"100 * {rule.part} > {rule.high} * {rule.whole}"] if rule.high is not None else []
        parts.append(f"case when {rule.whole} > 0 and ({' or '.join(sides)}) then '{rule.name}' end")
    return f"concat_ws(',', {', '.join(parts)})"


ORACLES["op5_quality_rules"] = rf"""
with split as (
  select doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '{_WORD}') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
grams as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as gram
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from split)),
repeated as (select doc_id, i from (select *, count(*) over (partition by doc_id, gram) as n from grams) where n >= 2),
covered as (
  select doc_id, count(distinct pos) as n_repeat_words
  from (select doc_id, unnest([i, i + 1, i + 2]) as pos from repeated) group by doc_id),
counts as (
  select split.doc_id, cast(len(words) as bigint) as n_words,
    cast(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) as bigint) as word_chars,
    cast(length(regexp_replace(body, '[^{SYMBOLS}]', '', 'g')) as bigint) as n_symbols,
    cast(length(regexp_replace(body, '[^!]', '', 'g')) as bigint) as n_exclamations,
    cast(len(list_filter(words, lambda w: lower(w) in ({', '.join(f"'{w}'" for w in STOP_WORDS)}))) as bigint) as n_stop_words,
    cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from split left join covered using (doc_id)),
judged as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words as base_failed,
    {_rule_sql()} as broken_rules
  from counts)
select *, not base_failed and broken_rules = '' as kept from judged
"""

ORACLES["op8_token_counts"] = rf"""
with kept as (
  select *, case when source = 'src0' then 'words/2' else 'words/1' end as tokenizer
  from documents where length(coalesce(text, '')) >= {SHORT_CHARS})
select source, lang, tokenizer, count(*) as n_docs,
  cast(sum(case when source = 'src0' then len(regexp_extract_all(text, '{VERSIONS["words/2"]}'))
    else len(regexp_extract_all(text, '{VERSIONS["words/1"]}')) end) as bigint) as n_tokens,
  cast(sum(length(text)) as bigint) as n_chars
from kept group by all
"""


def _spans_sql(rule: secret_scan.Rule) -> str:
    """(doc_id, kind, place, start, stop, tail): matches with the lengths of the texts between them in front."""
    head = re.sub("[A-Za-z]", lambda m: f"[{m[0].upper()}{m[0].lower()}]", rule.head.replace(r"\x20", " ")) if rule.either_case else rule.head
    tail = f"{rule.tail}{{{rule.first},}}" if rule.tail else ""
    pattern = f"({head}){tail}".replace("'", "''")
    ending = f"(?:{head})({tail})".replace("'", "''")
    groups = head.count("(") + 1
    return f"""
select doc_id, '{rule.kind}' as kind, {secret_scan.RULES.index(rule)} as place, unnest(starts) as start, unnest(stops) as stop, unnest(tails) as tail
from (
  select doc_id, list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(gaps[:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0)) as starts,
    list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(gaps[:i], lambda x: length(x))) + list_sum(list_transform(hits[:i], lambda x: length(x)))) as stops,
    list_transform(hits, lambda x: length(regexp_extract(x, '{ending}', {groups}))) as tails
  from (
    select doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') as hits, regexp_split_to_array(coalesce(text, ''), '{pattern}') as gaps
    from documents where regexp_matches(coalesce(text, ''), '{pattern}')))"""


def _scan_sql() -> str:
    spans = " union all ".join(f"select * from ({_spans_sql(rule)}) where tail >= {rule.least if rule.tail else 0}" for rule in secret_scan.RULES)
    base = ", ".join(f"'{rule.kind}'" for rule in secret_scan.BASE_RULES)
    counts = ", ".join(f"coalesce(count(*) filter (where kind = '{rule.kind}'), 0) as n_{rule.kind}" for rule in secret_scan.BASE_RULES)
    text = "kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, place"
    return f"""
with spans as ({spans})
select documents.doc_id, {counts}, sha256(coalesce(string_agg({text}) filter (where kind in ({base})), '')) as base_sha256,
  coalesce(string_agg({text}), '') as spans
from documents left join spans using (doc_id) group by documents.doc_id"""


ORACLES["op11_secret_scan"] = _scan_sql()

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op12_lexical_search"] = rf"""
with split as (select doc_id, regexp_extract_all({_LOWERED}, '{_TERM}') as terms from documents),
docs as (select doc_id, terms, len(terms) as n from split where len(terms) > 0),
total as (select count(*) as docs, sum(n) as terms from docs),
asked as (
  select item_id, term, count(*) as times
  from (select item_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) as term from benchmark) group by all),
held as (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(terms) as term from docs) group by all),
weights as (
  select term, cast(floor(1000 * ln((2 * total.docs + 2) / (2 * count(*) + 1))) as bigint) as w
  from held, total where term in (select term from asked) group by term, total.docs),
scored as (
  select item_id, doc_id,
    cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total.docs) // total.terms)))) as bigint) as score
  from asked join weights using (term) join held using (term), total group by item_id, doc_id),
ranked as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""

_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda a, u: xor(a >> 1, 3988292384 * (a & 1)))))"""

ORACLES["op13_prefix_trie"] = f"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as place,
    md5(coalesce(role, '') || chr(1) || coalesce(text, '')) as h, length(coalesce(text, '')) as size
  from conversations where conv_id is not null),
convs as (select conv_id, conv_id - conv_id % 100 as base, {_CRC32} % 6 as h from (select distinct conv_id from turns)),
rebuilt as (
  select convs.conv_id, 0 as part, turns.place, turns.h, size from convs join turns on turns.conv_id = base and turns.place < convs.h
  union all
  select convs.conv_id, 1 as part, turns.place, turns.h, size from convs join turns on turns.conv_id = convs.conv_id and turns.place >= convs.h),
steps as (
  select conv_id, row_number() over (partition by conv_id order by part, place) as depth, size,
    string_agg(h, '') over (partition by conv_id order by part, place rows unbounded preceding) as key
  from rebuilt
  union all select conv_id, 0, 0, '' from convs),
nodes as (select key, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size from steps group by key),
linked as (select *, case when depth > 0 then substr(key, 1, length(key) - 32) end as up from nodes),
children as (select up as key, count(*) as n_children from linked where up is not null group by up),
full_nodes as (select linked.*, coalesce(n_children, 0) as n_children from linked left join children using (key)),
below as (
  select substr(key, 1, 32 * d) as key, count(*) filter (where n_children = 0) as n_leaves, sum((n_convs - 1) * size) as saved_tokens
  from (select *, unnest(range(0, depth + 1)) as d from full_nodes) group by all),
ends as (
  select key, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids
  from (select conv_id, max_by(key, depth) as key from steps group by conv_id) group by key)
select node.conv_id, cast(node.depth as bigint) as depth, parent.conv_id as parent_conv_id, node.n_convs, node.n_children, n_leaves,
  cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from full_nodes node join below using (key) left join nodes parent on parent.key = node.up left join ends on ends.key = node.key
"""
