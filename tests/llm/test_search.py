"""Secrets, ranked search and the prefix trie against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferryline.llm import lexical_search, prefix_trie, secret_scan
from tests.llm.conftest import LONG_WORD, ODD_ROWS, prose

EITHER = re.compile("[A-Za-z]")
PIECES = [
    "token", "Token", "password", "passwd", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "abc123", "a", "f0" * 5, "AKIA", "AKIAAKIA",
    "ABCDEF0123456789", "\n", ", ", "é", "x" * 9, "secret", "xoxb-", "0123456789abcdef", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "z9" * 20, "eyJ", ".",
]


def found_by_regex(text, rules=secret_scan.RULES):
    out = []
    for number, rule in enumerate(rules):
        head = EITHER.sub(lambda m: f"[{m[0].upper()}{m[0].lower()}]", rule.head.replace(r"\x20", " ")) if rule.either_case else rule.head
        for hit in re.finditer(f"(?:{head})(?P<tail>{rule.tail}{{{rule.first},}})" if rule.tail else head, text):
            if not rule.tail or len(hit["tail"]) >= rule.least:
                out.append((rule.kind, hit.start(), hit.end(), number))
    return [(kind, start, end) for kind, start, end, _ in sorted(out, key=lambda f: (f[1], f[3]))]


def spans_of(frame):
    return {(r.doc_id, i): [tuple(s) for s in r.spans] for i, r in enumerate(frame.collect())}


def test_scanner_against_regular_expressions():
    scanner, draw = secret_scan.Scanner(secret_scan.RULES), random.Random(5)
    for _ in range(150):
        texts = ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 50))) for _ in range(draw.randint(1, 70))]
        for text, found in zip(texts, scanner.findings([t.encode() for t in texts]), strict=True):
            points = secret_scan._code_points(text.encode(), found)
            assert [(secret_scan.RULES[n].kind, a, b) for a, n, b in points] == found_by_regex(text)


def test_short_values_use_up_their_characters():
    scanner = secret_scan.Scanner(secret_scan.BASE_RULES)
    assert scanner.findings([b"token=token: abcdef", b"token= token: abcdef", b"x token: abcdef"]) == [[], [], [(2, 0, 15)]]


def test_texts_longer_than_blocks_and_lanes(monkeypatch):
    monkeypatch.setattr(secret_scan, "FEW_LANES", 2)
    scanner = secret_scan.Scanner(secret_scan.RULES)
    text = ("a" * 3000 + " password = 'hunter22' " + prose(3, 400) + "é AKIA" + "Q7" * 12 + "," + "0f" * 40 + LONG_WORD) * 3
    assert [(secret_scan.RULES[n].kind, a, b) for a, n, b in secret_scan._code_points(text.encode(), scanner.findings([text.encode()])[0])] == found_by_regex(text)
    assert len(found_by_regex(text)) == 12


def test_minimised_automaton_has_no_two_alike_states():
    scanner = secret_scan.Scanner(secret_scan.BASE_RULES)
    table = scanner.all.table.reshape(-1, scanner.all.width)
    rows = {(mark, *row) for mark, row in zip(scanner.all.marks, table.tolist(), strict=True)}
    assert len(rows) == len(table)


@pytest.mark.parametrize("bad", ["a(b", "a**b|^", "[é]", "a\\d"])
def test_unknown_expressions_are_errors(bad):
    with pytest.raises((ValueError, IndexError)):
        secret_scan.Scanner([secret_scan.Rule("bad", bad)])


def test_scan_of_odd_rows(odd, empty, monkeypatch):
    monkeypatch.setattr(secret_scan, "BLOCK_BYTES", 500)
    secret = "APIKEY: 'abcdef'"
    rows = odd.withColumn("text", F.when(F.col("doc_id") == 11, F.concat("text", F.lit(" ü " + secret))).otherwise(F.col("text"))).withColumn("spans", F.lit(1))
    found = secret_scan.scan(rows).collect()
    assert len(found) == len(ODD_ROWS)
    texts = {d: (t or "") for d, t, *_ in ODD_ROWS}
    for row in found:
        text = texts[row.doc_id] + (" ü " + secret if row.doc_id == 11 else "")
        assert [tuple(s) for s in row.spans] == found_by_regex(text)
    assert [len(r.spans) for r in found if r.doc_id == 11] == [1]
    assert secret_scan.scan(empty).count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def ranked_by_hand(docs, items, k):
    """[(item, rank, doc, score)] by the formula, every document scored in full."""
    terms = [(name, TERM.findall((text or "").translate(ASCII_LOWER))) for name, text in docs]
    terms = [(name, own) for name, own in terms if own]
    n_docs, n_terms = len(terms), sum(len(own) for _, own in terms)
    df = Counter(t for _, own in terms for t in set(own))
    out = []
    for item, text in items:
        asked, scored = TERM.findall((text or "").translate(ASCII_LOWER)), []
        for name, own in terms:
            counts, m = Counter(own), 75 + 25 * len(own) * n_docs // n_terms
            weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in asked}
            score = sum(weights[t] * (1_000_000_000 * counts[t] // (1000 * counts[t] + 12 * m)) for t in asked)
            if score > 0:
                scored.append((-score, name is None, name or 0, name))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def answers(frame):
    return sorted(((r[0], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=str)


ITEMS = [(1, prose(2, 30)), (2, "the THE river Straße 日本語の文章"), (3, None), (4, ""), (5, "unheard words only"), (6, prose(1, 8) + " stone " * 3), (6, "Größe"), (None, "river stone")]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("k,block,paired", [(3, 16 << 20, 8), (3, 700, 8), (2, 1, 3), (20, 2000, 0)])
def test_search(odd, items, monkeypatch, k, block, paired):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical_search, "PAIRED_TERMS", paired)
    found = answers(lexical_search.search(odd, items, k))
    assert found == ranked_by_hand([(d, t) for d, t, *_ in ODD_ROWS], ITEMS, k)


def test_search_in_groups_of_queries(odd, items, monkeypatch):
    monkeypatch.setattr(lexical_search, "GROUP_BYTES", 150)
    assert answers(lexical_search.search(odd, items, 4)) == ranked_by_hand([(d, t) for d, t, *_ in ODD_ROWS], ITEMS, 4)


def test_search_of_nothing(odd, empty, items):
    assert lexical_search.search(empty, items, 3).count() == 0
    assert lexical_search.search(odd, items.limit(0), 3).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical_search.search(odd, items.filter("item_id = 3"), 3).count() == 0


def test_pair_bounds_spare_postings_that_single_maxima_do_not():
    """Two frequent terms that seldom meet, and a rare one that decides."""
    n = 400
    texts = [["a"] * 9 if i % 2 else ["b"] * 9 for i in range(n)]
    texts[:20] = [["c"] * 20] * 20
    texts[20] = ["a", "b"]
    queries = lexical_search.Queries.of(["a b c"])
    chosen = np.array([[0, 1], [0, 2], [1, 2]])
    share = {c: np.array([1_000 * t.count(c) // (t.count(c) + 2) for t in texts]) for c in "abc"}
    at = {c: np.flatnonzero(share[c]).astype(np.int32) for c in "abc"}
    flat = np.concatenate([share[c][at[c]] for c in "abc"])
    terms = np.concatenate([np.full(len(at[c]), i, np.int32) for i, c in enumerate("abc")])
    most = np.array([share[c].max() for c in "abc"])
    lists = [np.intersect1d(at[x], at[y]).astype(np.int32) for x, y in ("ab", "ac", "bc")]
    joint = [int((share[x] + share[y])[rows].max(initial=0)) for (x, y), rows in zip(("ab", "ac", "bc"), lists, strict=True)]
    packed = lexical_search.join_arrays([terms, np.concatenate([at[c] for c in "abc"]), flat, most])
    pairs = lexical_search.join_arrays([np.arange(3), np.array(joint), np.array([len(x) for x in lists]), np.concatenate(lists)])
    read = {}
    for name, known in (("pairs", set(map(tuple, chosen.tolist()))), ("singles", set())):
        block = lexical_search.Block(list(range(n)), packed, pairs, chosen)
        best = lexical_search.Best(5, np.zeros(0, np.int64), np.zeros(0, np.int64))
        lexical_search.look_up(block, queries.terms[0], queries.times[0], known, best)
        read[name] = lexical_search.look_up(block, queries.terms[0], queries.times[0], known, best), best.scores.tolist()
    assert read["pairs"][0] < read["singles"][0] and read["pairs"][1] == read["singles"][1]


def trie_by_hand(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(nodes[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(node))
        children = sum(len(n) == len(node) + 1 for n in below)
        parent = min(nodes[node[:-1]]) if node else None
        out.append((min(members), len(node), parent, len(members), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made_conversations(seed, convs, longest):
    draw, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(draw.randint(0, longest)):
            rows.append((c * 7 % 640, t if t != 2 else None, draw.choice(["user", None, "assistant"]), draw.choice(["é", "go on", None, "", "a b"])))
    rows += [(900 + i, t, "user", f"same {t}") for i in range(12) for t in range(6)]
    rows += [(1300, t, "user", f"long {t}") for t in range(60)] + [(1301 + n, t, "user", f"long {t}") for n in range(9) for t in range(6 * n + 1)]
    return rows + [(None, 1, "user", "lost"), (5, 1, "user", "twice"), (5, 1, "user", "twice"), (-3, 0, "user", "below")]


@pytest.mark.parametrize("chunk,ids", [(4096, 65_536), (3, 2)])
def test_trie(spark, monkeypatch, chunk, ids):
    monkeypatch.setattr(prefix_trie, "IDS_A_ROW", ids)
    monkeypatch.setattr(prefix_trie.running, "__defaults__", (chunk,))
    # Turns of one number have no order of their own: rows here tie only where they are equal.
    rows = [r for r in made_conversations(3, 60, 7)]
    seen, clean = {}, []
    for row in rows:
        if seen.setdefault(row[:2], row) == row:
            clean.append(row)
    frame = spark.createDataFrame(clean, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).repartition(3)
    got = sorted((tuple(r) for r in prefix_trie.trie(frame.filter("conv_id is null or conv_id >= 0")).collect()), key=str)
    assert got == trie_by_hand([r for r in clean if r[0] is None or r[0] >= 0])


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(none).count() == 0
    one = spark.createDataFrame([(7, None, None, None)], none.schema)
    assert sorted((tuple(r) for r in prefix_trie.trie(one).collect()), key=str) == trie_by_hand([(7, None, None, None)])


def test_two_fattest_numbers(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(0, 40)]
    frame = spark.createDataFrame(pairs, "low long, high long").withColumn("f", prefix_trie.fattest(F.col("low"), F.col("high")))
    for low, high, f in frame.collect():
        inside = range(low + 1, high + 1)
        assert f == (max(inside, key=lambda n: n & -n) if inside else None)


def test_one_look_up_ends_the_search_for_an_edge(spark, monkeypatch):
    """The plan of a batch has to stay small, whatever is written in between."""
    monkeypatch.setattr(prefix_trie, "materialise", lambda df, label: df)
    steps = spark.createDataFrame([(1, d, f"{d:032x}") for d in range(61)] + [(2, d, f"{d + 100 * (d > 40):032x}") for d in range(51)], "path long, depth long, at string")
    node = [(1, 0, 60, *(f"{d:032x}" for d in (0, 60, 32, 1)))]
    nodes = spark.createDataFrame(node, "owner long, above long, below long, start string, end string, handle string, entry string")
    found = prefix_trie.locate(spark.createDataFrame([(2, 50)], "path long, n long"), nodes, steps, 60)
    assert [tuple(r) for r in found.select("path", "owner", "leaves").collect()] == [(2, 1, 40)]
    assert found._jdf.queryExecution().analyzed().toString().count("Join ") <= 2 * (6 - 4) + 4
