"""Prefix trie, secret scans and periodic runs: brute force, SQL, odd rows, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from drillspectra.llm import automata, periodic, prefix_trie, secrets
from drillspectra.llm.periodic import recurrences, runs_of

CLASHING = ["row", "spans", "runs", "words", "path", "sizes", "shard", "base", "turns", "head", "h", "n", "a", "p", "g", "skeleton", "kept", "depth"]


def _clash(df):
    for name in CLASHING:
        df = df.withColumn(name, F.lit(name))
    return df


# Periodic runs

def _plain_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                out.setdefault((i - q, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def _repetitive(r, most):
    words = []
    while len(words) < r.randint(0, most):
        if r.random() < 0.5:
            unit = [r.randint(0, 3) for _ in range(r.randint(1, 9))]
            words += (unit * r.randint(1, 7))[: r.randint(1, 60)]
        else:
            words.append(r.randint(0, 3))
    return words


def test_runs_of_random_words_equal_all_periods():
    r = random.Random(11)
    for _ in range(1500):
        words = _repetitive(r, 90)
        found, lags = recurrences(np.array(words, np.int64), np.arange(len(words)), len(words) // 4)
        assert runs_of(found.tolist(), lags.tolist()) == _plain_runs(words)


def _plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = _plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_run_digests_of_odd_rows(spark, tmp_path):
    r = random.Random(5)
    rows = [(None, "a a a a a a a"), (None, None), (1, None), (2, ""), (3, " \n\t "), (3, "x y " * 9), (4, "é é\x1cé é é é\x0bé é é é")]
    rows += [(i, " ".join(f"w{w}" for w in _repetitive(r, 60))) for i in range(10, 90)]
    rows += [(100, "on and on " * 9000), (101, "one " * 50_000), (102, " ".join(str(i % 4001) for i in range(17_000)))]
    _clash(spark.createDataFrame(rows, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op13(spark, str(tmp_path)).collect()
    want = [_plain_digest(*row) for row in rows if row[0] not in (100, 101, 102)]
    assert sorted((tuple(g) for g in got if g["doc_id"] not in (100, 101, 102)), key=str) == sorted(want, key=str)
    plain = {row["doc_id"]: row for row in periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 100").collect()}
    assert [(x.start, x.length, x.period) for x in plain[100]["runs"]] == [(0, 27_000, 3)] and plain[100]["collapsed"] == "on and on"
    assert [(x.start, x.length, x.period) for x in plain[101]["runs"]] == [(0, 50_000, 1)] and plain[101]["n_words"] == 50_000
    assert [(x.start, x.length, x.period) for x in plain[102]["runs"]] == [(0, 17_000, 4001)]
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Secret scans

BITS = ["password", "token", "apikey", "Api_Key", "secret", "PASSWD", "=", ":", " ", "'", '"', "abc", "AKIA", "0f3a", "ZZ9", "\n", ",", "é", "eyJ", ".", "ghp_",
        "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "xoxb-", "-", "ſecret=abcdefgh", "toKen=abcdefgh", "f" * 23, "a" * 30]


@pytest.mark.parametrize("lane, few", [(8, 1), (64, 4), (256, 48)])
def test_automata_find_what_regular_expressions_find(monkeypatch, lane, few):
    monkeypatch.setattr(automata, "LANE", lane)
    monkeypatch.setattr(automata, "FEW_LANES", few)
    r = random.Random(lane)
    patterns = tuple(rule.pattern for rule in secrets.RULES) + ("(?:ab|a|abc0?){2,3}z?",)
    for _ in range(250):
        texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 120))).encode() for _ in range(4)]
        borders = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = automata.matches(patterns, np.frombuffer(b"".join(texts), np.uint8), borders)
        want = [(i, int(borders[i]) + m.start(), int(borders[i]) + m.end(), k)
                for i, text in enumerate(texts) for k, p in enumerate(patterns[:-1]) for m in re.finditer(p.encode(), text)]
        assert sorted(g for g in got if g[3] < len(patterns) - 1) == sorted(want)


def test_minimal_automaton_has_no_equal_states():
    found = automata.Automaton(("a(?:b|c)d", "(?:ab|ac)d"))
    assert found.table.shape[0] == 5 and sorted(found.accepts.tolist()) == [0, 0, 0, 0, 3]  # start, a, ab or ac, end, nothing
    with pytest.raises(ValueError):
        automata.Automaton(("a(?=b)",))


def _plain_spans(text):
    out = []
    for number, rule in enumerate(secrets.RULES):
        out += [(m.start(), number, rule.kind, m.end()) for m in re.finditer(rule.pattern, text or "", re.A) if len(m[rule.group]) >= rule.least]
    return [(kind, start, stop) for start, _, kind, stop in sorted(out)]


def test_spans_of_odd_rows(spark):
    r = random.Random(9)
    rows = [(None, "token=abcdef é"), (None, None), (1, ""), (2, "é" * 9 + "password: 'hunter22'"), (3, "token=token:abcdefgh"), (4, "token==abcdefg")]
    rows += [(i, "".join(r.choice(BITS) for _ in range(r.randint(0, 90)))) for i in range(5, 200)]
    rows += [(200, "0" * 300_000), (201, "é, " * 100_000 + "AKIA" + "Z" * 16), (1, "")]
    df = _clash(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("text", F.col("text"))
    got = secrets.find_secrets(df).collect()
    assert sorted(((g["row"]["doc_id"], g["row"]["text"], [tuple(s) for s in g["spans"]]) for g in got), key=str) == \
        sorted(((d, t, _plain_spans(t)) for d, t in rows), key=str)
    assert all(g["row"][c] == c for g in got[:3] for c in CLASHING)
    hidden = {(row["doc_id"], row["text"]) for row in secrets.masked(df).select("doc_id", "text").collect()}
    assert (2, "é" * 9 + "*" * 19 + "'") in hidden and (None, None) in hidden and (200, "*" * 300_000) in hidden
    assert secrets.find_secrets(df.limit(0)).count() == 0


# Prefix trie

def _plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in turns.items()}
    again = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        again[c] = own.get(c - c % 100, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in again.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(again[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(3 * n), n):
        texts = [r.choice("abé") for _ in range(r.choice([1, 2, 4, 7]))] if r.random() < 0.6 else ["hello", "there", "again"]
        rows += [(c, i, r.choice(["user", "user", None]), t) for i, t in enumerate(texts)]
    return rows


ODD_TURNS = [(None, 0, "user", "lost"), (5, None, None, None), (5, 0, "user", ""), (5, 0, "user", ""), (6, 1, "u", "b"), (6, 1, "u", "a"), (7, 0, "", None),
             (100, None, "user", "x"), (101, 0, "user", "x"), (102, 2, "user", "y"), (103, 0, "ab", "c"), (104, 0, "a", "bc")]


@pytest.mark.parametrize("shard, skeleton", [(1 << 24, 1 << 20), (400, 1 << 20), (300, 1500)])
def test_trie_equals_a_plain_trie(spark, monkeypatch, shard, skeleton):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = _conversations(shard, 260) + ODD_TURNS + [(900, i, "user", f"t{i}") for i in range(120)]
    turns = _clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(5)
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_paths(turns)), shard, skeleton).collect()
    assert sorted((tuple(g) for g in got), key=str) == _plain_trie(rows)


def test_trie_of_copies_is_cut_inside_the_group(spark):
    rows = [(c, i, "user", t) for c in range(1000) for i, t in enumerate(["same", "thing", "again"])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    paths = prefix_trie.rebuilt(prefix_trie.turn_paths(turns))
    got = prefix_trie.prefix_trie(paths, shard_bytes=4000).collect()
    assert sorted((tuple(g) for g in got), key=str) == _plain_trie(rows)
    ends = hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()
    assert [g["ends_sha256"] for g in got if g["depth"] == 3] == [ends]


def test_trie_of_no_conversation(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_paths(turns))).count() == 0


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_secret_scan", "op13_periodic_runs"])
def test_queries_equal_their_sql(spark, name):
    from drillspectra.llm.queries import QUERIES, SQL

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for table in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = duck.sql(SQL[name])
    got = QUERIES[name](spark, folder).select(*want.columns).collect()
    assert sorted(map(str, (tuple(g) for g in got))) == sorted(map(str, want.fetchall()))
