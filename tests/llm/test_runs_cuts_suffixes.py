"""Operators 11, 12 and 13 against brute force: nulls, empty and long texts, ties, repeated rows, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phasewell.llm import fill_middle, periodic_runs, suffix_dedup
from phasewell.llm.text import Words

WORDS = re.compile("[^\x20\x09-\x0d]+")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def letters(n: int, seed: int, alphabet: str = "abcdefg é") -> str:
    r = random.Random(seed)
    return "".join(r.choice(alphabet) for _ in range(n))


def brute_runs(w: list[str], least: int) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, 2 * q) and not any(all(w[t] == w[t + d] for t in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def texts() -> list[tuple]:
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abcde"[: r.choice([1, 2, 3, 5])]) for _ in range(r.randint(0, 70)))) for i in range(60)]
    rows += [(100 + i, " ".join(r.choice(["eins", "zwei", "drei", "vier", "fünf"]) for _ in range(r.randint(1, 40))) + " \t\n" + "x y z " * r.randint(1, 9)) for i in range(30)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "a " * 5000), (204, "a b " * 12 + "c " + "a b " * 12), (204, "a b " * 12 + "c " + "a b " * 12), (None, "u v " * 8), (None, None)]
    return [(i, t, "r", "k") for i, t in rows]


def test_runs_of_words_against_brute_force():
    r = random.Random(1)
    for _ in range(150):
        docs = []
        for _ in range(r.randint(1, 5)):
            w = [r.choice("abcde"[: r.choice([1, 2, 3, 5])]) for _ in range(r.randint(0, 50))]
            if w and r.random() < 0.5:
                a = r.randrange(len(w))
                w = w[:a] + (w[a:] * r.randint(1, 6))[: r.randint(0, 80)] + [r.choice("abc") for _ in range(r.randint(0, 9))]
            docs.append(w)
        least = r.choice([2, 4, 7, 12])
        found = np.array(periodic_runs.runs_of_texts(Words(pa.array([" ".join(w) for w in docs], pa.large_string())), least)).T.tolist()
        assert [[tuple(x[1:]) for x in found if x[0] == i] for i in range(len(docs))] == [brute_runs(w, least) for w in docs]


def test_find_runs_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame(texts(), "doc_id bigint, text string, runs string, _r_words string").repartition(3)
    got = periodic_runs.find_runs(docs).collect()
    assert set(periodic_runs.find_runs(docs).columns) == {"doc_id", "text", "runs", "collapsed", "_r_words"} and len(got) == len(texts())
    for row in got:
        w = WORDS.findall(row["text"] or "")
        want = brute_runs(w, 12)
        assert [tuple(x) for x in row["runs"]] == want
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert row["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_tails_and_the_query(spark, tmp_path):
    rows = texts()
    spark.createDataFrame(rows, "doc_id bigint, text string, d string, e string").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for i, t, *_ in rows:
        w = WORDS.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        runs = brute_runs(w, 12)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want[(i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    got = periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == want and any(r["n_runs"] for r in got)


def test_cut_of_long_stretches_and_units():
    units = fill_middle.Units()
    for text in ("", "a", "é" * 5, "ab" * 40_000 + "1" + "c" * 70_000, "<P" + "x" * fill_middle.PART + "Y z", letters(3000, 4)):
        assert units.ends(text).tolist() == [m.end() for m in re.finditer(fill_middle.PATTERN, text)]


def test_fill_middle_against_brute_force(spark):
    rows = [(i, letters(random.Random(i).randint(0, 300), i, "ab <>PSM\né😀"), 7, "x") for i in range(120)]
    rows += [(300, None, 7, "x"), (301, "", 7, "x"), (302, "q<S>r", 7, "x"), (303, " ", 7, "x"), (304, "x" * 200_000, 7, "x"), (304, "x" * 200_000, 7, "x"), (None, "ohne Nummer", 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int, c string")
    out = fill_middle.transform(docs)
    assert set(out.columns) == {"doc_id", "text", "n", "c", "form", "prefix_chars", "middle_chars", "output"}
    got = out.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    seen = Counter()
    for r in got:
        t = r["text"] or ""
        digest = hashlib.sha256(f"1:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        u = re.findall(fill_middle.PATTERN, t)
        a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        want = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        lengths = (None, None) if form == "plain" else (len(p), len(m))
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) == (len(u), form, *lengths, want, t)
        seen[form] += 1
    assert len(seen) == 3 and len(got) == len(rows)


def passages() -> list[tuple]:
    p, q, near = letters(450, 900), letters(260, 901), letters(900, 902)
    rows = [(i, letters(90 + 7 * i, i) + p + letters(60, 50 + i)) for i in range(6)]
    rows += [(10, near), (11, near[:400] + "#" + near[401:]), (12, near[300:]), (20, q + letters(40, 77) + q), (21, "ab" * 300), (22, "z" * 199), (22, "z" * 199), (23, "y" * 200), (24, "y" * 200)]
    rows += [(30, letters(500, 31)), (30, letters(500, 31)), (31, None), (32, ""), (None, letters(500, 31)[:260]), (33, letters(199, 5) + "é"), (34, letters(2600, 6) + p)]
    return [(i, t, "a", 3) for i, t in rows]


def brute_kept(rows: list[tuple]) -> list[tuple]:
    width, data = suffix_dedup.WIDTH, [(t or "").encode() for _, t, *_ in rows]
    n = Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for (i, *_), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - width + 1):
            if n[b[k : k + width]] > 1:
                gone[k : k + width] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        out.append((i, len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone, strict=False) if not g))))
    return out


@pytest.mark.parametrize("hot", [1, 4096])
def test_suffix_dedup_against_brute_force(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 1: every mixed anchor goes the way of hot ones
    rows = passages()
    spark.createDataFrame(rows, "doc_id bigint, text string, key string, size int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = suffix_dedup.op12_suffix_dedup(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_kept(rows))


def test_suffix_dedup_removes_and_keeps_columns(spark):
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, size int")
    out = suffix_dedup.remove(docs)
    assert out.columns == docs.columns
    want = {(i, h) for i, _, _, _, h in brute_kept(rows)}
    got = out.collect()
    assert len(got) == len(rows) and {r["doc_id"] for r in got if r["text"] is None} == {31}
    assert {(r["doc_id"], sha(r["text"] or "")) for r in got} == want  # no character is cut through here


def test_windows_of_contexts_against_brute_force():
    r, width = random.Random(3), suffix_dedup.WIDTH
    for _ in range(25):
        base = [letters(600, r.randrange(10**6), "abcdefgh ").encode() for _ in range(3)]
        contexts = []
        for _ in range(r.randint(1, 20)):
            a, n = r.randrange(300), r.randint(width, 300)
            t = bytearray(r.choice(base)[a : a + n])
            if r.random() < 0.5:
                t[r.randrange(len(t))] = ord("X")
            contexts.append(b"a" * n if r.random() < 0.1 else bytes(t))
        weights = np.array([r.choice([1, 1, 1, 2]) for _ in contexts], float)
        n = Counter()
        for t, k in zip(contexts, weights, strict=True):
            for i in range(len(t) - width + 1):
                n[t[i : i + width]] += k
        for t, spans in zip(contexts, suffix_dedup.repeated_windows(contexts, weights), strict=True):
            assert [i for a, k in spans for i in range(a, a + k)] == [i for i in range(len(t) - width + 1) if n[t[i : i + width]] >= 2]


def test_equal_windows_share_anchors(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)  # texts go through in overlapping pieces
    p, width = letters(400, 1, "abcdefgh "), suffix_dedup.WIDTH
    docs = [letters(random.Random(i).randint(0, 900), i, "abcdefgh ") for i in range(20)] + [letters(50, i) + p for i in range(4)] + ["a" * 700, "abc" * 300]
    raw, anchors, places = [d.encode() for d in docs], defaultdict(set), Counter()
    for data, offsets, text, place in suffix_dedup.pieces(pa.array(docs, pa.large_string())):
        for part, start, n, anchor in zip(*suffix_dedup.contexts(data, offsets), strict=True):
            for k in range(start, start + n):
                at = place[part] + k - offsets[part]
                assert raw[text[part]][at : at + width] == data[k : k + width].tobytes()
                places[text[part], at] += 1
                anchors[data[k : k + width].tobytes()].add(anchor)
    assert set(places.values()) == {1} and len(places) == sum(max(0, len(b) - width + 1) for b in raw)
    assert {len(a) for a in anchors.values()} == {1}


@pytest.mark.parametrize("run", [periodic_runs.find_runs, periodic_runs.with_tails, fill_middle.transform, suffix_dedup.remove])
def test_empty_tables_of_runs_cuts_suffixes(spark, run):
    assert run(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
