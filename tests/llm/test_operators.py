"""Corpus operators and pipeline stages on small tables: odd rows, clashing columns, brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from drillspectra.llm import edits, html_text, language, licenses, lines, mixing, near_copies, tokens, topk, warc
from drillspectra.llm.components import components
from drillspectra.llm.license_texts import LICENSE_TEXTS
from drillspectra.llm.shingles import WIDTH

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; they must not get in each other's way.
CLASHING = ["row", "matches", "key", "rep", "slot", "block", "doc", "starts", "size", "_gone", "_key", "root", "n", "digest", "html", "held_out", "_file"]
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
COPY = "the quick brown fox jumps over the lazy dog and then it sleeps well"
ODD_ROWS = [
    (1, COPY, "en", "a", 66), (2, COPY, "en", "a", 66), (2, COPY, "en", "a", 66), (3, COPY.upper(), "en", None, 66),
    (4, None, "en", "a", None), (5, "", None, "b", 0), (6, " \n ", "de", "b", 3), (7, "!!! 123", "de", "b", 7),
    (None, COPY, "en", "b", 66), (None, None, None, None, None), (8, LONG, "de", "b", len(LONG)), (9, "é", "fr", "b", 1), (10, "two words", "fr", "c", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD_ROWS, DOCS)
    for name in CLASHING:
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def _sets(rows):
    out = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        out[doc_id] = {tuple(w[i : i + WIDTH]) for i in range(max(len(w) - WIDTH, 0) + 1)} if w else set()
    return out


def _grouped(sets):
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in sets}


def _varied(seed, groups=6, copies=14, words=60):
    r = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{r.randint(0, 400)}" for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])):
                w[r.randrange(len(w))] = f"v{r.randint(0, 9)}"
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("small, block", [(32, 2048), (2, 4)])
def test_near_copies_equal_all_pairs(spark, monkeypatch, small, block):
    monkeypatch.setattr(near_copies, "PAIR_BUCKET", small)
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", block)
    rows = _varied(7)
    got = {r["doc_id"]: r for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = _sets(rows)
    want = _grouped(sets)
    assert 1 < len(set(want.values())) < len(want)
    for doc_id, root in want.items():
        assert (got[doc_id]["component_id"], got[doc_id]["n_shingles"], got[doc_id]["kept"]) == (root, len(sets[doc_id]), doc_id == root)


def test_near_copies_of_odd_rows(odd, none):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_copies.near_copies(odd).collect()), key=str)
    assert len(got) == len(ODD_ROWS)
    by_id = defaultdict(list)
    for row in got:
        by_id[row[0]].append(row[1:])
    assert by_id[1] == [(10, 1, True)] and by_id[2] == [(10, 1, False)] * 2 and by_id[3] == [(10, 1, False)]
    assert by_id[4] == [(0, 4, True)] and by_id[6] == [(0, 6, True)] and by_id[10] == [(1, 10, True)]
    assert sorted(by_id[None]) == [(0, None, True), (10, None, True)]
    assert near_copies.near_copies(none).count() == 0


def test_words_that_cancel_in_a_power_series_do_not_meet(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)], "doc_id long, text string")
    got = {x["doc_id"]: (x["component_id"], x["kept"]) for x in near_copies.near_copies(docs).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False)}


def test_repeated_doc_id_joins_its_groups(spark):
    other = " ".join(f"z{i}" for i in range(30))
    rows = [(5, COPY), (5, other), (3, COPY), (9, other), (7, "apart from all of these others")]
    got = {(r["doc_id"], r["component_id"]) for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (7, 7)}


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    edges = spark.createDataFrame(chain + star + [(5, 5), (None, 3), (11, 10), (10, 11)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(200, 260)) and got[7] == 7
    assert got[10] == got[11] == 10 and 5 not in got and 3 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_languages_are_held_out_and_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.identified(docs, language.train(docs)).select("row.doc_id", "row.lang", "lang_pred", "score").toPandas()
    held = found[[zlib.crc32(str(d).encode()) % 4 == 2 for d in found.doc_id]]
    assert len(found) == docs.count() and (held.lang == held.lang_pred).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_language_ignores_all_but_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = language.train(docs)
    plain = {r["doc_id"]: r["lang_pred"] for r in language.identified(docs, trees).select("row.doc_id", "lang_pred").collect()}
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert plain == {r["doc_id"]: r["lang_pred"] for r in language.identified(other, trees).select("row.doc_id", "lang_pred").collect()}
    changed = docs.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert language.train(changed).langs == trees.langs and (language.train(changed).cost == trees.cost).all()


def test_language_of_odd_rows(odd, none):
    got = language.identified(odd, language.train(odd)).select("row.doc_id", "row.text", "row.row", "lang_pred", "score").collect()
    assert len(got) == len(ODD_ROWS) and {r["row"] for r in got} == {"row"}
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == letters and (r["score"] > 0) == letters
    assert language.train(none) is None and language.identified(none, None).count() == 0
    assert {r["lang_pred"] for r in language.identified(odd, None).collect()} == {"und"}


def test_token_stream_of_odd_rows(spark, odd, none):
    got = sorted((tuple(r) for r in tokens.packed_tokens(odd).collect()), key=lambda r: r[1])
    codes = tokens.encoder("word_bpe_49k.json").library
    want, start = [], 0
    for doc_id, text in sorted(((r[0], r[1]) for r in ODD_ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = codes.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert tokens.packed_tokens(none).count() == 0


def test_shards_close_and_start_where_the_last_ended(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words {i} here") for i in range(50)], "doc_id long, text string").coalesce(1)
    shards = tokens.write_shards(docs, f"file:{tmp_path}", shard_tokens=20)
    rows = shards.collect()
    assert sum(r["documents"] for r in rows) == 50
    got = sorted(tokens.read_shards(shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == list(range(50)) and got[0]["start"] == 0
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))


def test_exact_top_with_ties_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in r.normal(size=6).astype(np.float32)]) for i in range(120)]
    rows += [(i, rows[50][1]) for i in range(200, 230)] + [(300, None), (350, [1.0, None]), (400, [float("nan")]), (450, [float("inf"), 1.0]), (None, [1.0])]
    rows += [rows[3], (500, []), (550, [2.0, 1.0])]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("ints", F.lit("clash")))
    got = sorted(tuple(x) for x in topk.exact_top(vectors, vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")).collect())
    table = {i: np.floor(np.array(v, np.float32).astype(float) * 256).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(i for i in table if i % 50 == 0):
        score = {i: int(sum(a * b for a, b in zip(table[q], v))) for i, v in table.items() if i != q}
        want += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5])]
    assert got == want
    few = vectors.where("vec_id IN (0, 1, 2)")
    assert topk.exact_top(few, few.where("vec_id = 0").withColumnRenamed("vec_id", "query_id")).count() == 2
    empty = vectors.where("false")
    assert topk.exact_top(empty, empty.withColumnRenamed("vec_id", "query_id")).count() == 0


def test_warc_of_odd_pages(spark, tmp_path):
    big = "<p>" + "x" * 1200
    rows = [(1, "u", big), (2, "u", big), (5, None, big), (5, "again", big), (None, "u", big), (3, "u", "short"), (4, "u", "short"), (6, "u\r\nx: y", None),
            (7, "u", ""), (None, None, None), (8, "u", "é" * 700), (9, "u", "é" * 700), (10, "u", "y" * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("payload", F.lit(1))
    got = warc.read_archives(warc.write_archives(pages, f"file:{tmp_path}"), with_payload=True).collect()
    assert len(got) == len(rows)
    latest = {big: 5, "é" * 700: 9}
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        refers = latest.get(html) if page != latest.get(html) else None
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers else "response", refers, None if refers else raw))
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[3])
    have = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert warc.read_archives(warc.write_archives(pages.where("false"), f"file:{tmp_path}/none")).count() == 0
    kind = "record_id string, record_type string, refers_to_id string, payload_digest string, payload_bytes long"
    known = [("a", "response", None, "d", 5), ("b", "revisit", "a", "d", 5), ("c", "revisit", "a", "e", 5), ("e", "revisit", "x", "d", 5), ("f", "revisit", "a", "d", None)]
    assert sorted(r["record_id"] for r in warc.broken_revisits(spark.createDataFrame(known, kind)).collect()) == ["c", "e"]


def test_contamination_of_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(edits, "ITEM_BLOCK", 2)
    items = spark.createDataFrame([(1, "Quick brown FOX -- jumps over the lazy dog!"), (1, "quick brown fox jumps over the lazy dig"), (2, None), (3, ""), (4, "short"),
                                   (None, "and then it sleeps well, over the lazy dog"), (5, "something else that no document holds at all")], "item_id long, text string")
    got = edits.contamination(odd, items).select("row.doc_id", "row.text", "row.matches", F.col("matches").alias("found")).collect()
    assert len(got) == len(ODD_ROWS) and {r["matches"] for r in got} == {"matches"}
    for r in got:
        held = (r["text"] or "").lower() == COPY
        assert [(m["item_id"], m["distance"]) for m in r["found"]] == ([(1, 0)] if held else [])
    assert edits.contamination(none, items).count() == 0
    assert [r["matches"] for r in edits.contamination(odd, items.where("false")).select("matches").collect()] == [[]] * len(ODD_ROWS)


def test_short_items_are_held_as_whole_words(spark):
    items = [(1, "Paris"), (2, "In 1789, of course"), (3, "é"), (4, "..."), (5, "a b"), (5, "b a"), (None, "PARIS!"), (6, "the longest item of this table, by far")]
    rows = [(1, "It is paris."), (2, "comparison; Parisian"), (3, "in 1789 of  course: Paris"), (4, "in 1780 of course"), (5, "cafe\u0301 é"), (6, "caf\u00e9"), (7, "a b a b"), (8, None), (9, "..."),
            (10, "x the longest item of this tabel, by far paris")]
    got = edits.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: [(m["item_id"], m["distance"]) for m in r["matches"]] for r in got.select("row.doc_id", "matches").collect()}
    paris = [(1, 0), (None, 0)]
    assert got == {1: paris, 2: [], 3: [(1, 0), (2, 0), (None, 0)], 4: [], 5: [(3, 0)], 6: [], 7: [(5, 0)], 8: [], 9: [], 10: [(1, 0), (6, 2), (None, 0)]}


def test_one_benchmark_text_under_many_ids(spark, monkeypatch):
    monkeypatch.setattr(edits, "ITEM_BLOCK", 2)
    items = spark.createDataFrame([(i, COPY) for i in range(30)] + [(None, COPY)], "item_id long, text string")
    got = edits.contamination(spark.createDataFrame([(1, "so " + COPY), (2, "no")], "doc_id long, text string"), items).select("row.doc_id", "matches").collect()
    assert {r["doc_id"]: [(m["item_id"], m["distance"]) for m in r["matches"]] for r in got} == {1: [(i, 0) for i in range(30)] + [(None, 0)], 2: []}


def test_license_texts_in_other_spellings(spark, odd, none):
    known = spark.createDataFrame(LICENSE_TEXTS + [(None, "no id"), ("NULL", None), ("EMPTY", "...")], "license_id string, text string")
    mit = LICENSE_TEXTS[0][1]
    rows = [(1, mit), (2, "Copyright (c) 2001 Some One\n * (C) 2003 Other\nAll rights reserved.\n\n" + mit.upper()), (3, mit.replace("license", "licence").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")),
            (4, mit + " and more"), (5, None), (6, ""), (7, "Copyright 2000 X"), (8, "Released   under the M.I.T Licence"), (9, "released under the mit LICENCE"), (9, "x")]
    got = sorted(((r["doc_id"], r["license_id"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()), key=str)
    assert got == sorted([(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, None), (5, None), (6, None), (7, None), (8, None), (9, "MIT"), (9, None)], key=str)
    assert licenses.scan_licenses(odd, known).count() == len(ODD_ROWS) and licenses.scan_licenses(none, known).count() == 0
    assert licenses.scan_licenses(odd, known.where("false")).where("license_id IS NOT NULL").count() == 0


def test_license_lookup_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_DIGESTS", 0)
    known = spark.createDataFrame(LICENSE_TEXTS, "license_id string, text string")
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(LICENSE_TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(docs, known).collect()}
    assert got == {i: name for i, (name, _) in enumerate(LICENSE_TEXTS)}


def _without_repeats(rows, window=3, run_words=40):
    cut = {}
    for doc_id, text in rows:
        parts, now = [], ""
        for i, c in enumerate(text or ""):
            now += c
            if c == "\n" or (c == " " and i and text[i - 1] in ".!?"):
                parts.append(now)
                now = ""
        cut[doc_id] = parts + ([now] if now else [])
    seen, out = set(), {}
    for doc_id in sorted(cut):
        full = [i for i, p in enumerate(cut[doc_id]) if p.split()]
        dead = set()
        for at in range(len(full) - window + 1):
            content = tuple(cut[doc_id][full[at + s]].strip().lower() for s in range(window))
            if content in seen:
                dead |= {at + s for s in range(window)}
            seen.add(content)
        for at in sorted(dead):
            if at - 1 not in dead:
                run = [at]
                while run[-1] + 1 in dead:
                    run.append(run[-1] + 1)
                if sum(len(cut[doc_id][full[i]].split()) for i in run) < run_words:
                    dead -= set(run)
        gone = {full[i] for i in dead}
        out[doc_id] = ("".join(p for i, p in enumerate(cut[doc_id]) if i not in gone), len(full), len(gone))
    return out


def test_repeated_runs_go_wherever_they_stand(spark, odd, none):
    r = random.Random(6)
    sentence = lambda: " ".join(r.choice("alpha beta gamma delta".split()) + str(r.randint(0, 9)) for _ in range(r.randint(1, 14))) + r.choice([". ", "!\n", "\n", ".\n\n"])
    passages = [[sentence() for _ in range(n)] for n in (2, 3, 5, 9)]
    rows = []
    for i in range(60):
        body = [sentence() for _ in range(r.randint(0, 6))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(body))
            body[at:at] = r.choice(passages)
        rows.append((i, "".join(body)))
    rows.append((60, "again. " * 100))
    got = {x["doc_id"]: (x["text"], x["n_lines"], x["n_removed"]) for x in lines.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), by_words=False).collect()}
    want = _without_repeats(rows)
    assert got == want and sum(n for _, _, n in want.values()) > 100
    kept = lines.drop_repeated_runs(odd).collect()
    assert len(kept) == len(ODD_ROWS) and all(x["n_removed"] == 0 for x in kept)
    assert sorted(str(x["text"]) for x in kept) == sorted(str(x[1]) for x in ODD_ROWS)
    assert lines.drop_repeated_runs(none).count() == 0


def test_repeated_rows_count_as_one_document(spark):
    text = "\n".join(f"line {i} " + "word " * 10 for i in range(8))
    rows = [(4, text), (4, text), (9, "head\n" + text), (None, text)]
    got = sorted(((str(x["doc_id"]), x["n_removed"]) for x in lines.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [("4", 0), ("4", 0), ("9", 8), ("None", 8)]


def _without_repeats_by_words(rows, window=3, run_words=40):
    cut = {d: [p for p in re.split(r"(?<=\n)|(?<=[.!?] )", t or "") if p] for d, t in rows}
    seen, out = set(), {}
    for doc_id in sorted(cut):
        parts = cut[doc_id]
        full = [i for i, p in enumerate(parts) if p.split()]
        size = [len(parts[i].split()) for i in full]
        dead = set()
        for n in range(1, window + 1):
            for at in range(len(full) - n + 1):
                if n == window or sum(size[at : at + n]) >= run_words:
                    content = tuple(parts[full[at + s]].strip().lower() for s in range(n))
                    if content in seen:
                        dead |= set(range(at, at + n))
                    seen.add(content)
        for at in [a for a in sorted(dead) if a - 1 not in dead]:
            run = [at]
            while run[-1] + 1 in dead:
                run.append(run[-1] + 1)
            if sum(size[i] for i in run) < run_words:
                dead -= set(run)
        gone = {full[i] for i in dead}
        out[doc_id] = ("".join(p for i, p in enumerate(parts) if i not in gone), len(full), len(gone))
    return out


def test_passages_of_one_and_two_lines_go_by_their_words(spark):
    r = random.Random(8)
    sentence = lambda n: " ".join(r.choice("alpha beta gamma delta".split()) + str(r.randint(0, 99)) for _ in range(n)) + r.choice([". ", "!\n", "\n"])
    passages = [[sentence(n) for n in sizes] for sizes in ([55], [30, 25], [20, 19], [40], [39], [10, 20, 9], [14, 14, 14], [3, 60, 3])]
    rows = [(0, passages[0][0].strip()), (1, "head " * 9 + "\n" + passages[0][0]), (2, passages[0][0] + passages[0][0])]
    for i in range(3, 60):
        body = [sentence(r.randint(1, 9)) for _ in range(r.randint(0, 4))]
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(body))
            body[at:at] = r.choice(passages)
        rows.append((i, "".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: (x["text"], x["n_lines"], x["n_removed"]) for x in lines.drop_repeated_runs(docs).collect()}
    want = _without_repeats_by_words(rows)
    assert got == want and sum(n for _, _, n in want.values()) > 60
    assert [want[d][2] for d in range(3)] == [0, 1, 2]
    by_lines = {x["doc_id"]: x["n_removed"] for x in lines.drop_repeated_runs(docs, by_words=False).collect()}
    assert by_lines[1] == by_lines[2] == 0  # three whole lines only


def test_mixture_keeps_every_row_and_its_shares(spark, odd, none):
    r = random.Random(8)
    rows = [(i, r.choice(["a"] * 6 + ["b", "c"]), r.randint(0, 300)) for i in range(3000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, size long"), {"a": 2.0, "b": 1.0, "c": 1.0}, block_bytes=500)
    got = got.select("row.*", "block", "release", "deadline", "slot", "place").toPandas()
    assert sorted(got.doc_id) == list(range(3000)) and (got.release <= got.slot).all() and (got.slot < got.deadline).all()
    blocks = got.groupby(["source", "block"]).slot.nunique()
    assert (blocks == 1).all() and not got.groupby("slot")[["source", "block"]].nunique().gt(1).any().any()
    starts = got.sort_values(["source", "block", "place"])
    for _, part in starts.groupby("source"):
        at = part.block.to_numpy() * 500 + part.place.to_numpy()
        assert at[0] == 0 and (np.diff(at) == part["size"].to_numpy()[:-1] + 1).all()
    wide = odd.select("doc_id", "source", F.octet_length("text").alias("size"), "n", "key", "row", "_key", "block", "slot", F.lit("p").alias("place"))
    kept = mixing.mixed(wide).collect()
    assert len(kept) == len(ODD_ROWS) and all((k["row"]["block"], k["row"]["place"], k["row"]["_key"]) == ("block", "p", "_key") for k in kept)
    behind = mixing.mixed(wide, {"a": 0.9, "b": 0.1, "x": 5}).collect()
    assert len(behind) == len(ODD_ROWS)
    late = [b for b in behind if b["row"]["source"] not in ("a", "b")]
    assert len(late) == 3 and all(b["release"] is None and b["slot"] > max(x["slot"] for x in behind if x["row"]["source"] in ("a", "b")) for b in late)
    assert mixing.mixed(none.withColumn("size", F.col("n_chars"))).count() == 0


def test_pages_of_all_kinds(spark):
    rows = [(1, "u", "<p>a<p>b"), (1, "u", "<p>a<p>b"), (2, None, None), (None, "u", ""), (3, "u", "<script>x</script>"), (4, "u", "<i>" * 400 + "deep" + "y " * 100_000)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    text = [(r["page_id"], r["text"]) for r in got]
    assert text[:5] == [(1, "a\n\nb"), (1, "a\n\nb"), (2, None), (None, ""), (3, "")] and text[5][1].startswith("deepy y")


def test_stages_on_odd_and_empty_rows(spark, odd, none, tmp_path):
    docs = odd
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == odd.columns, name
        assert stage(spark, none, SF).columns == none.columns
        assert stage(spark, none, SF).count() == 0
        out.write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
    kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(kept, key=str) == sorted([(1, COPY), (8, LONG), (9, "é"), (10, "two words"), (None, COPY)], key=str)
    packed = corpus_pipeline.pack_tokens(spark, docs, SF).collect()
    assert len(packed) == 5 and corpus_pipeline.pack_tokens(spark, none, SF).count() == 0


def test_pipeline_equals_its_stages_done_plainly(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    packed = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r["start"])
    sets = _sets([(d, r["text"]) for d, r in docs.items()])
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    near = {tuple(sorted((a, b))) for ds in holders.values() for a in ds for b in ds if a < b}
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in near:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    items = [edits.folded(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {d for d, r in docs.items() if find(d) == d and not any(i in edits.folded(r["text"]) for i in items)}
    assert {r["doc_id"] for r in packed} == want
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(packed, packed[1:])) and packed[0]["start"] == 0
    assert [r["doc_id"] for r in packed] != sorted(want)  # the stream is in the order of the mixture
