"""Chained stages against plain loops: fit by aggregations, two-pass calling, switching, observed events, raw tests, features."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasewell.functions import tests_of_fit
from phasewell.functions.intervals import judge_event
from phasewell.operators import assembly, calling, chain, features, fit, observed, phasing, switching, validation
from phasewell.plans import catalog
from phasewell.sources import matrices


def simulated(genes: int = 2, reads: int = 40, sites: int = 8, seed: int = 1) -> list[tuple]:
    """(geneID, Read, snv_id, r, pi, score, CellType) of reads of two haplotypes with errors and gaps."""
    r, out = random.Random(seed), []
    for g in range(genes):
        hap = [r.random() < 0.5 for _ in range(sites)]
        score = [round(r.uniform(0.3, 0.99), 3) for _ in range(sites)]
        for i in range(reads):
            on_a = r.random() < 0.65
            for j in range(sites):
                if r.random() < 0.7:
                    alt = hap[j] == on_a if j % 4 else r.random() < 0.2
                    code = 2 if r.random() < 0.03 else int(alt != (r.random() < 0.05))
                    out.append((f"g{g}", f"r{i}", f"s{j}", code, 10 ** -r.uniform(0.8, 3), score[j], "xy"[i % 2]))
    return out


def kernel(rows: pd.DataFrame, **options) -> tuple[phasing.Phased, np.ndarray]:
    reads, i = np.unique(rows["Read"], return_inverse=True)
    sites, j = np.unique(rows["snv_id"], return_inverse=True)
    score = np.zeros(len(sites))
    score[j] = rows["score"]
    return phasing.phase_observed(i, j, rows["r"].to_numpy(), rows["pi"].to_numpy(), len(reads), score, **options), sites


def test_fit_by_aggregations_equals_the_kernel(spark):
    rows = simulated()
    names = ["geneID", "Read", "snv_id", "r", "pi", "score", "CellType"]
    codes = spark.createDataFrame(rows, "geneID string, Read string, snv_id string, r int, pi double, score double, CellType string").repartition(4)
    reads, sites, genes = (x.toPandas() for x in fit.fit_bulk(codes.drop("CellType"), ["geneID"], max_iter=3))
    table = pd.DataFrame(rows, columns=names)
    for g, own in table.groupby("geneID"):
        full, order = kernel(own, max_iter=3)
        null, _ = kernel(own, max_iter=3, fixed_alpha=0.5)
        got = genes[genes.geneID == g].iloc[0]
        assert math.isclose(got.alpha_hat, min(full.alpha, 1 - full.alpha), abs_tol=1e-6) and got["rounds"] == full.rounds
        assert math.isclose(got.ll_alt, full.loglik, abs_tol=1e-5) and math.isclose(got.ll_null, null.loglik, abs_tol=1e-5)
        x = max(0.0, 2 * (full.loglik - null.loglik))
        assert math.isclose(got.p_value, math.erfc(math.sqrt(x / 2)), abs_tol=1e-5)
        mine = sites[sites.geneID == g].set_index("snv_id")
        at = [k for k, s in enumerate(order) if s in mine.index]
        assert len(at) == len(mine) and all(full.marker[k] == 0 for k in range(len(order)) if k not in at)
        assert np.allclose(mine.loc[order[at], "h_A"], full.h[at], atol=1e-6) and np.allclose(mine.loc[order[at], "h_m"], full.marker[at], atol=1e-6)
        hat = reads[reads.geneID == g].set_index("Read")["hat"]
        assert np.allclose(hat.loc[np.unique(own["Read"])], full.hat, atol=1e-6)
    bulk = spark.createDataFrame(sites[["geneID", "snv_id", "h_A", "h_m"]])
    by_type = fit.fit_cell_types(codes, bulk, ["geneID"], max_iter=3)[1].toPandas()
    assert len(by_type) == 4
    for (g, ct), own in table.groupby(["geneID", "CellType"]):
        mine = sites[sites.geneID == g].set_index("snv_id")
        order = np.unique(own["snv_id"])
        frozen = (mine["h_A"].reindex(order).fillna(0.5).to_numpy(), mine["h_m"].reindex(order).fillna(0.0).to_numpy())
        full, _ = kernel(own, max_iter=3, frozen=frozen)
        null, _ = kernel(own, max_iter=1, frozen=frozen, fixed_alpha=0.5)
        got = by_type[(by_type.geneID == g) & (by_type.CellType == ct)].iloc[0]
        assert math.isclose(got.alpha_hat, min(full.alpha, 1 - full.alpha), abs_tol=1e-6)
        assert math.isclose(got.ll_alt, full.loglik, abs_tol=1e-5) and math.isclose(got.ll_null, null.loglik, abs_tol=1e-5)


@pytest.mark.parametrize("files", [1, 2])
def test_equal_line_numbers_take_the_tables_order(spark, tmp_path, files):
    """The first of a read's rows with one line number counts, though the later rows lie in a larger file that is read first."""
    keys = list(range(400))
    line = "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_returnflag string, l_quantity double"
    spark.createDataFrame([(k, f"Brand#{k % 3}", "T", 1) for k in keys], "p_partkey bigint, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    first, second = [(k, k, 1, "A", 20.0) for k in keys], [(k, k, 1, "N", 30.0) for k in keys]
    more = [(1000 + i, keys[i % 400], 1, "R", 10.0) for i in range(4000)]
    (tmp_path / "lineitem.parquet").mkdir()
    for n, rows in enumerate([first + second + more] if files == 1 else [first, second + more]):
        frame = pd.DataFrame(rows, columns=[x.split()[0] for x in line.split(", ")]).astype({"l_linenumber": "int32"})
        frame.to_parquet(tmp_path / "lineitem.parquet" / f"{n}.parquet", row_group_size=300)
    codes = catalog.QUERIES["em_input_codes"](spark, str(tmp_path)).where("Read < 1000").toPandas()
    assert len(codes) == 400 and (codes["pi"] == 0.01).all() and (codes["r"] == 2).all()


def test_fit_in_tasks_equals_fit_by_rounds(spark):
    """One gene above the limit of a task, one below; a third has no code, and no row."""
    rows = [x for x in simulated() if x[0] == "g0" or int(x[1][1:]) < 20] + [("g9", "r1", "s1", -1, 0.1, 0.5, "x")]
    codes = spark.createDataFrame(rows, "geneID string, Read string, snv_id string, r int, pi double, score double, CellType string").repartition(4)
    sizes = {g: sum(x[0] == g for x in rows) for g in ("g0", "g1")}
    assert sizes["g1"] < 150 < sizes["g0"]
    tables = []
    for most in (0, 150, 10**6):
        bulk = fit.fit_bulk(codes.drop("CellType"), ["geneID"], most, max_iter=2)
        by_type = fit.fit_cell_types(codes, bulk[1], ["geneID"], in_task=most // 2, max_iter=2)
        tables.append([x.toPandas().sort_values(x.columns[:2] if x.columns[1] in ("Read", "snv_id") else x.columns[0]).reset_index(drop=True) for x in bulk] + [by_type[0].toPandas().sort_values(["geneID", "CellType", "Read"]).reset_index(drop=True), by_type[1].toPandas().sort_values(["geneID", "CellType"]).reset_index(drop=True)])
    for other in tables[1:]:
        for a, b in zip(tables[0], other, strict=True):
            assert set(a["geneID"]) == {"g0", "g1"}
            pd.testing.assert_frame_equal(a, b[a.columns], rtol=0, atol=1e-5, check_dtype=True)


def test_genes_that_fit_a_task_need_no_rounds(spark, monkeypatch):
    codes = spark.createDataFrame(simulated(reads=20), "geneID string, Read string, snv_id string, r int, pi double, score double, CellType string")
    monkeypatch.setattr(fit, "fit", None)
    _, sites, genes = fit.fit_bulk(codes.drop("CellType"), ["geneID"])
    assert genes.count() == 2 and fit.fit_cell_types(codes, sites, ["geneID"])[1].count() == 4


def test_site_update_minimises_the_mixture():
    """M4: the share found is where -sum log(z/2 emission + (1 - z) noise) is least, by a fine grid."""
    r = np.random.default_rng(3)
    fixed, rising = r.uniform(0.05, 0.6, 60), r.uniform(-0.04, 0.04, 60)
    site = np.repeat([0, 1, 2], 20)
    best, grid = phasing._best_h(site, fixed, rising, 3), np.linspace(0, 1, 20_001)
    for j in range(3):
        loss = -np.log(fixed[site == j][:, None] + rising[site == j][:, None] * grid).sum(0)
        assert abs(best[j] - grid[loss.argmin()]) < 1e-4


def test_tails_of_chi_square(spark):
    xs = [(x, df) for x in (0.0, 1e-9, 0.3, 3.84, 12.4, 12.6, 60.0, 400.0) for df in (1, 2, 3, 4, 7)]
    want = [upper_tail(x, df) for x, df in xs]
    got = [r[0] for r in spark.createDataFrame(xs, "x double, df int").coalesce(1).select(tests_of_fit.chi2_sf(F.col("x"), F.col("df"))).collect()]
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-300) for a, b in zip(got, want, strict=True))
    none = spark.createDataFrame([(None, 1), (float("nan"), 1), (1.0, 0), (1.0, None)], "x double, df int")
    assert [r[0] for r in none.select(tests_of_fit.chi2_sf(F.col("x"), F.col("df"))).collect()] == [None] * 4


def upper_tail(x: float, df: int) -> float:
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(df // 2))
    out, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for i in range((df - 1) // 2):
        out, term = out + term, term * x / (2 * i + 3)
    return out


REF = "".join(random.Random(8).choice("ACGT") for _ in range(700))


def small_alignments(seed: int = 4) -> list[tuple]:
    r, out = random.Random(seed), []
    for k in range(260):
        pos, cigar, seq, qual, p = r.randrange(0, 480), [], "", [], 0
        for op, n in ([(0, r.randint(20, 60))], [(4, 3), (0, 25), (2, r.randint(1, 3)), (0, 30)], [(0, 30), (1, 2), (0, 20), (3, 90), (0, 22), (5, 4)])[k % 3]:
            cigar.append((op, n))
            for _ in range(n if op in (0, 1, 4) else 0):
                ref = REF[pos + p] if op == 0 else "A"
                at = pos + p
                b = ref if op else ("ACGT"[("ACGT".index(ref) + 1) % 4] if at % 23 == 7 and k % 2 else r.choice("ACGTN") if r.random() < 0.03 else ref)
                seq, p = seq + b, p + (op == 0)
                qual.append(r.randint(2, 40))
            p += n if op in (2, 3) else 0
        out.append(("s1" if k % 4 else "s2", f"m/{k % 250}/ccs" + ("_3" if k % 5 == 0 else ""), "c1", pos, 256 if k % 31 == 0 else 16 * (k % 2), 10 if k % 29 == 0 else 50, cigar, seq, qual))
    return out


def brute_calls(reads: list[tuple], genes: list[tuple], allowed: set | None, depth: int, alt: int, het: float) -> tuple[dict, set]:
    canonical = lambda n: n.rsplit("_", 1)[0] if "/ccs_" in n else n
    first = {}
    for x in sorted(reads, key=lambda x: (x[2], x[3], x[4])):
        if not x[4] & 0x904:
            first.setdefault((x[0], x[1]), x)
    sums, seen, deleted = defaultdict(lambda: [0, 0]), set(), Counter()
    for gene, _, lo, hi in genes:
        for sample in ("s1", "s2"):
            count, bases, dels = defaultdict(lambda: [0, 0]), [], []
            for s, name, _, pos, flag, mapq, cigar, seq, qual in first.values():
                name = canonical(name)
                if s != sample or mapq < 20 or allowed is not None and (s, gene, name) not in allowed:
                    continue
                p, q = pos, 0
                for op, n in cigar:
                    for i in range(n if op in (0, 2) else 0):
                        if lo <= p + i <= hi:
                            if op == 2:
                                dels.append(p + i)
                                continue
                            b, near = seq[q + i], min(q + i, len(seq) - 1 - q - i) < 3
                            if qual[q + i] >= 5 and not (b != REF[p + i] and near):
                                bases.append((p + i, name, q + i, b, qual[q + i], mapq, len(seq), int(flag & 16 != 0)))
                                if b in "ACGT":
                                    count[p + i][b != REF[p + i]] += 1
                    p, q = p + (n if op in (0, 2, 3) else 0), q + (n if op in (0, 1, 4) else 0)
            own = set()
            for p, (a, b) in count.items():
                like = [0.6 * 0.5 ** (a + b), 0.1 * 0.99**a * 0.01**b, 0.3 * 0.01**a * 0.99**b]
                if a + b >= depth and b > alt and like[0] / sum(like) >= het * 0.8 / 0.99:
                    own.add(p)
                    sums[gene, p][0] += a + b
                    sums[gene, p][1] += b
            seen |= {(gene, *x) for x in bases if x[0] in own}
            deleted.update((gene, p) for p in dels if p in own)
    return {k: (*v, deleted[k]) for k, v in sums.items()}, seen


ALIGNED = "sample string, qname string, chrom string, pos bigint, flag int, mapq int, cigar array<struct<op:int,len:int>>, seq string, qual array<int>"


@pytest.fixture(scope="module")
def called(spark):
    reads, genes = small_alignments(), [("g1", "c1", 20, 260), ("g2", "c1", 240, 520)]
    tiles = spark.createDataFrame([("c1", k, REF[k : k + 50]) for k in range(0, 700, 50)], "chrom string, start bigint, seq string")
    regions = spark.createDataFrame(genes, "geneID string, geneChr string, geneStart bigint, geneEnd bigint")
    frame = spark.createDataFrame(reads, ALIGNED).repartition(3)
    return reads, genes, frame, regions, tiles


@pytest.mark.parametrize("limited", [False, True])
def test_two_passes_against_plain_loops(spark, called, limited):
    reads, genes, frame, regions, tiles = called
    allowed = {(s, g, f"m/{k}/ccs") for s in ("s1", "s2") for g in ("g1", "g2") for k in range(250) if k % 7} if limited else None
    names = spark.createDataFrame(sorted(allowed), "sample string, geneID string, Read string") if limited else None
    sites, seen = calling.call_sites(frame, regions, tiles, 50, names, depth=6, alt=1, het=0.3)
    want, want_seen = brute_calls(reads, genes, allowed, 6, 1, 0.3)
    got = {(r.geneID, r.pos): (r.depth, r.alt_count, r.del_count) for r in sites.collect()}
    assert got == want and len(got) > 10 and any(v[2] for v in got.values())
    rows = [tuple(r) for r in seen.select("geneID", "pos", *calling.OBSERVED).collect()]
    assert set(rows) == want_seen and len(rows) == len(want_seen)


def test_features_against_plain_loops(spark, called):
    _, _, frame, regions, tiles = called
    sites, seen = calling.call_sites(frame, regions, tiles, 50, depth=6, alt=1, het=0.3)
    named = sites.join(calling.alt_vote(seen, calling.SITE).select(*calling.SITE, "alt"), calling.SITE)
    bare = named.limit(1).select("geneID", "chrom", F.lit(2).cast("bigint").alias("pos"), F.lit("A").alias("ref"), *[c for c in named.columns if c not in ("geneID", "chrom", "pos", "ref", "alt", "del_count")], F.lit(4).cast("bigint").alias("del_count"), F.lit("C").alias("alt"))
    full = features.site_features(named.unionByName(bare), seen, tiles, 50)
    by_site = defaultdict(list)
    for r in seen.collect():
        by_site[r.geneID, r.pos].append(r)
    rows = full.collect()
    assert set(features.FEATURES) <= set(full.columns) and len(rows) == sites.count() + 1
    for f in rows:
        own = [o for o in by_site[f.geneID, f.pos] if o.base in "ACGT"]
        a, b = [o for o in own if o.base == f.alt], [o for o in own if o.base == f.ref]
        mean = lambda x, d=0.0: float(np.mean(x)) if x else d
        assert (f.depth, f.alt_count) == (len(own), len(a)) and math.isclose(f.mean_mapq, mean([o.mapq for o in own]))
        assert math.isclose(f.mean_bq_alt, mean([o.baseq for o in a])) and math.isclose(f.mean_bq_ref, mean([o.baseq for o in b]))
        assert f.n_distinct_alt == sum(n >= 2 for x, n in Counter(o.base for o in own).items() if x != f.ref)
        places = [o.qpos / (o.read_len - 1) for o in a]
        assert math.isclose(f.alt_pos_on_read_mean, mean(places, 0.5)) and math.isclose(f.alt_pos_on_read_std, float(np.std(places)) if len(places) > 1 else 0.0, abs_tol=1e-12)
        rf, rr, af, ar = (1 + sum(o.is_reverse == v for o in x) for x in (b, a) for v in (0, 1))
        odds = rf * ar / (rr * af)
        assert math.isclose(f.strand_sor, math.log(odds + 1 / odds) + math.log(min(rf, rr) / max(rf, rr)) - math.log(min(af, ar) / max(af, ar)), abs_tol=1e-12)
        assert math.isclose(f.del_frac, f.del_count / (len(own) + f.del_count) if own or f.del_count else 0.0)
        lo = max(0, f.pos - 5)
        w, at = REF[lo : f.pos + 6].ljust(11, "N"), f.pos - lo
        longest = max(len(x) for x in "".join(c if i == 0 or c == w[i - 1] else " " + c for i, c in enumerate(w)).split())
        assert math.isclose(f.gc_content_11bp, sum(c in "GC" for c in w) / 11) and (f.homopolymer_len, f.is_homopolymer_ge5) == (longest, int(longest >= 5))
        assert f.creates_homopolymer == int(f.alt in (w[at - 1], w[at + 1])) and f.flanking_is_AT == int(w[at - 1] in "AT" and w[at + 1] in "AT")
    scored = features.scored_sites(full, features.Logistic({"depth": 0.01}, 0.0), ["geneID"])
    scores = {(r.geneID, r.pos): (r.score, r.depth) for r in scored.collect()}
    skipped = {g for (g, p) in scores if p == 2}
    assert all((s is None) == (g in skipped) for (g, _), (s, _) in scores.items()) and len(skipped) == 1
    assert all(s is None or math.isclose(s, 1 / (1 + math.exp(-0.01 * d))) for s, d in scores.values())
    kept = {(r.geneID, r.pos) for r in features.hard_filter(scored, 0.53).collect()}
    assert kept == {k for k, (s, _) in scores.items() if s is None or s >= 0.53}
    alone = features.site_features(named, seen).first()
    assert (alone.gc_content_11bp, alone.homopolymer_len, alone.flanking_is_AT) == (0.5, 1, 0)


def brute_boundary(exons: list[tuple], down: str, up: str) -> set:
    iso = defaultdict(set)
    for name, s, e in exons:
        iso[name].add((s, e))
    events, tr = set(), defaultdict(set)
    for name, own in iso.items():
        own = sorted(own)
        ev = {("exon", *x) for x in own} | {("junction", a[1], b[0]) for a, b in zip(own, own[1:], strict=False)}
        tr[name.split("-")[0]] |= ev
        events |= {x for x in ev if (x[2] - x[1] >= 5 if x[0] == "exon" else x[1] != x[2])}
    a, b = tr[down], tr[up]
    ends = lambda x: {p for k, s, e in x if k == "exon" for p in (s, e)}
    kept = set()
    for own, other in ((a, b), (b, a)):
        for p in ends(a) & ends(b):
            here = {x for x in own if p in x[1:]}
            inside = [x in other for x in here]
            if any(inside) and not all(inside) or len(here) == 1 and not inside[0]:
                kept.add(p)
    free, reached = events - (a & b), set(kept)
    found = set()
    while True:
        more = {x for x in free if reached & set(x[1:])}
        if more == found:
            return found
        found, reached = more, reached | {p for x in more for p in x[1:]}


def test_boundary_events_against_plain_search(spark):
    r, exons, pairs, want = random.Random(6), [], [], {}
    for g in range(14):
        rows = []
        for name in ("T1-a", "T1-b", "T2-a", "T3-a", "T3-b"):
            at = r.randrange(0, 4) * 10
            for _ in range(r.randint(1, 6)):
                n = r.choice([3, 10, 20])
                rows.append((name, at, at + n))
                at += n + r.choice([0, 10, 20, 30])
        exons += [(f"g{g}", *x) for x in rows]
        down, up = r.sample(["T1", "T2", "T3"], 2)
        pairs.append((f"g{g}", "Bulk", down, up))
        want[f"g{g}"] = brute_boundary(rows, down, up)
    pairs.append(("g0", "one", "T1", "T1"))
    events = switching.isoform_events(spark.createDataFrame(exons, "geneID string, Isoform string, s bigint, e bigint"))
    structures = switching.transcript_structures(events, r"T\d")
    found = switching.boundary_events(structures, switching.gene_events(events), spark.createDataFrame(pairs, "geneID string, CellType string, down string, up string"), ["geneID", "CellType"])
    got = defaultdict(set)
    for x in found.collect():
        got[x.geneID].add((x.event_type, x.s, x.e))
        assert x.CellType == "Bulk"
    assert got == {g: x for g, x in want.items() if x} and len(got) > 5
    modes = {m: switching.filter_events(found.withColumn("p_value_adj", F.lit(0.2)), m, 0.1, found) for m in ("all_events", "fdr_events", "switching_events")}
    assert [modes[m].count() for m in modes] == [found.count(), 0, found.count()]
    with pytest.raises(ValueError):
        switching.filter_events(found, "other")


def test_long_chains_of_touching_events(spark):
    chain = [("g", i * 10, i * 10 + 10) for i in range(300)] + [("g", 5001, 5007), ("h", 0, 10)]
    labels = switching.touching(spark.createDataFrame(chain, "geneID string, s bigint, e bigint"), ["geneID"])
    got = {(x.geneID, x.pos): x.label for x in labels.collect()}
    assert got == {**{("g", i * 10): 0 for i in range(301)}, ("g", 5001): 5001, ("g", 5007): 5001, ("h", 0): 0, ("h", 10): 0}


def test_annotated_junctions_replace_gaps(spark):
    exons = spark.createDataFrame([("g", "T1", 0, 10), ("g", "T1", 20, 30), ("g", "T2", 0, 10), ("h", "T9", 0, 10), ("h", "T9", 10, 14), (None, "T5", 1, 2)], "geneID string, Isoform string, s bigint, e bigint")
    gtf = spark.createDataFrame([("g", "T1", 0, 8), ("g", "T1", 22, 30), ("g", "T1", 29, 40), ("g", "T7", 0, 5), ("g", "T7", 9, 12), ("g", None, 0, 1)], "geneID string, transcript string, s bigint, e bigint")
    index = switching.junction_index(gtf)
    assert {tuple(x) for x in index.collect()} == {("g", "T1", 8, 22), ("g", "T7", 5, 9)}
    rows = {tuple(x) for x in switching.isoform_events(exons, index).where("event_type = 'junction'").collect()}
    assert rows == {("g", "T1", "junction", 8, 22), ("h", "T9", "junction", 10, 10)}
    assert switching.gene_events(switching.isoform_events(exons, index)).where("geneID = 'h'").count() == 1


def test_observed_events_against_all_pairs(spark):
    r = random.Random(9)
    reads, blocks, events = [], [], []
    for g in ("g", "h"):
        for i in range(60):
            at, own = r.randrange(0, 900), []
            for _ in range(r.randint(1, 5)):
                n = r.randint(3, 140)
                own.append((at, at + n))
                at += n + r.choice([0, 20, 60, 400, 9000])
            hat = round(r.random(), 3)
            reads += [(g, f"r{i}", hat, 1 - hat)] * r.randint(1, 2)
            if i % 9:
                blocks.append((g, f"r{i}", own, [(a[1], b[0]) for a, b in zip(own, own[1:], strict=False) if a[1] < b[0]]))
        for _ in range(50):
            s = r.randrange(0, 3000)
            events.append((g, r.choice(["exon", "junction"]), s, s + r.choice([5, 20, 90, 600])))
        events += [(g, "junction", b[2][k][1] + r.randint(-9, 9), b[2][k + 1][0] + r.randint(-9, 9)) for b in blocks if b[0] == g for k in range(len(b[2]) - 1) if r.random() < 0.3]
    iv = "array<struct<s:bigint,e:bigint>>"
    rd, bl = spark.createDataFrame(reads, "geneID string, Read string, hat_I double, hat_I_B double"), spark.createDataFrame(blocks, f"geneID string, Read string, blocks {iv}, introns {iv}")
    ev = spark.createDataFrame(events, "geneID string, event_type string, s bigint, e bigint")
    got = {tuple(x)[:4]: tuple(x)[4:] for x in observed.observed_events(rd, bl, ev, ["geneID"]).collect()}
    told = rd.distinct().join(bl, ["geneID", "Read"], "left").join(ev.distinct(), "geneID").withColumn("said", judge_event(F.col("event_type"), F.col("s"), F.col("e"), F.col("blocks"), F.col("introns")))
    want = defaultdict(lambda: dict.fromkeys([(h, x) for h in "AB" for x in ("include", "skip", "unobserved")], 0.0))
    for x in told.collect():
        for h, w in (("A", x.hat_I), ("B", x.hat_I_B)):
            want[x.geneID, x.event_type, x.s, x.e][h, x.said] += w
    assert got.keys() == want.keys() and all(np.allclose(got[k], list(want[k].values()), atol=1e-9) for k in got)
    assert all(any(v[h, x] > 0 for k, v in want.items() if k[1] == kind) for kind in ("exon", "junction") for h in "AB" for x in ("include", "skip", "unobserved"))


def test_equal_alignments_are_judged_once(spark):
    """Fifty copies of reads weigh fifty times, but no more is judged; reads don't meet events one by one."""
    iv = "array<struct<s:bigint,e:bigint>>"
    shapes = {"one": ([(0, 100)], []), "two": ([(0, 60), (160, 300)], [(60, 160)]), "gap": ([(0, 60), (64, 90), (160, 300)], [(90, 160)])}
    events = spark.createDataFrame([("g", t, s, s + n) for t in ("exon", "junction") for s in range(0, 300, 7) for n in (5, 40, 100)] + [("g", "junction", 80, 60)], "geneID string, event_type string, s bigint, e bigint")

    def judged(copies: int):
        names = [(f"{k}{i}", k) for k in shapes for i in range(copies)]
        reads = spark.createDataFrame([("g", n, "xy"[k == "two"], 0.75, 0.25) for n, k in names], "geneID string, Read string, CellType string, hat_I double, hat_I_B double")
        blocks = spark.createDataFrame([("g", n, *shapes[k]) for n, k in names], f"geneID string, Read string, blocks {iv}, introns {iv}")
        by = ["geneID", "CellType"]
        out = observed.observed_events(reads, blocks, events, by)
        assert "Read#" not in out._jdf.queryExecution().optimizedPlan().toString()
        rows = observed.block_shapes(reads, blocks, by).count()
        return {tuple(x)[:5]: np.array(tuple(x)[5:]) for x in out.collect()}, rows

    (one, few), (many, same) = judged(1), judged(50)
    assert few == same == 3 and one.keys() == many.keys()
    assert all(np.allclose(many[k], 50 * one[k]) for k in one) and sum(one.values()).min() > 0


def test_raw_validation_against_plain_loops(spark):
    r = random.Random(12)
    isoforms = {"i1": {("exon", 0, 50), ("junction", 50, 90)}, "i2": {("exon", 0, 50), ("exon", 60, 80)}, "i3": {("exon", 200, 240)}}
    events = spark.createDataFrame([("g", i, *x) for i, own in isoforms.items() for x in own], "geneID string, Isoform string, event_type string, s bigint, e bigint")
    seen, reads = [], []
    for k in range(120):
        reads += [("g", f"r{k}", i, "xy"[k % 2]) for i in r.sample(sorted(isoforms), 1 if k % 5 else 2)]
        seen += [("g", "c", p, f"r{k}", q, r.choice("AAAGGGTN")) for p in (30, 55, 300) if r.random() < 0.8 for q in range(r.randint(1, 2))]
    links = [("g", t, s, e, "c", p, "A", alt, n) for t, s, e in (("exon", 0, 50), ("junction", 50, 90), ("exon", 200, 240)) for p, alt, n in ((30, "G", 1), (55, "g", 2), (55, "g", 3), (300, None, 4), (55, "N", 5), (999, "G", 6))]
    links += [("no", "exon", 0, 50, "c", 30, "A", "G", 7)]
    kinds = "geneID string, event_type string, s bigint, e bigint, chrom string, snv_pos bigint, snv_ref string, snv_alt string, n int"
    alleles = validation.read_alleles(spark.createDataFrame(seen, "geneID string, chrom string, pos bigint, Read string, qpos int, base string"), ["qpos", "base"])
    held = spark.createDataFrame(reads, "geneID string, Read string, Isoform string, CellType string")
    for typed in (False, True):
        frame = spark.createDataFrame(links, kinds)
        frame = frame.withColumn("CellType", F.lit("x")) if typed else frame
        got = validation.raw_validation(frame, alleles, held if typed else held.drop("CellType"), events).collect()
        assert len(got) == len(links)
        of, member = {}, defaultdict(set)
        for _, n, i, ct in reads:
            if not typed or ct == "x":
                member[n].add(i)
        for x in sorted(seen, key=lambda x: (x[4], x[5])):
            if x[5] in "ACGT":
                of[x[2], x[3]] = x[5]
        ps = {}
        for row in got:
            if row.geneID == "no" or row.snv_alt not in ("G", "g"):
                assert row.raw_test_type is None and row.raw_ref_present is None and row.raw_p_value_adj is None
                continue
            event, n = (row.event_type, row.s, row.e), Counter()
            intra = row.event_type == "exon" and row.s <= row.snv_pos <= row.e
            for (p, name), base in of.items():
                if p == row.snv_pos and member[name]:
                    has = {event in isoforms[i] for i in member[name]}
                    if intra or len(has) == 1:
                        n[base, True if intra else has.pop()] += 1
            cells = [n[x, y] for x in "AG" for y in (True, False)]
            assert [row.raw_ref_present, row.raw_ref_absent, row.raw_alt_present, row.raw_alt_absent] == cells
            a, b, c, d = cells
            if intra:
                p = min(1.0, 2 * sum(math.comb(a + c, i) for i in range(min(a, c) + 1)) / 2 ** (a + c)) if a + c >= 10 else None
                assert row.raw_test_type == "binomial_intra_event" and row.raw_chi2 is None
            else:
                margins = (a + b) * (c + d) * (a + c) * (b + d)
                p = math.erfc(math.sqrt(sum(cells) * (a * d - b * c) ** 2 / margins / 2)) if sum(cells) >= 10 and margins else None
                assert row.raw_test_type == "chi2_cross_event"
            assert (row.raw_p_value is None) == (p is None) and (p is None or math.isclose(p, row.raw_p_value, rel_tol=1e-9))
            if p is not None:
                ps[row.event_type, row.s, row.snv_pos, row.n] = (p, row.raw_p_value_adj)
        order = sorted(ps.values())
        low = 1.0
        for k in range(len(order), 0, -1):
            low = min(low, order[k - 1][0] * len(order) / k)
            assert math.isclose(order[k - 1][1], low, rel_tol=1e-9)
        assert len(order) >= 4


def test_event_table_keeps_rows_and_meets_missing_keys(spark):
    kinds = "geneID string, event_type string, event_start bigint, event_end bigint"
    weights = "geneName string, geneChr string, hapA_present double, hapA_absent double, hapB_present double, hapB_absent double, chi2 double, p_value double, p_value_adj double"
    events = spark.createDataFrame([("g", "exon", 1, 9, "G", "c", 3.0, 1.0, 1.0, 3.0, 2.0, 0.1, 0.2), ("g", "junction", 9, 20, "G", None, 0.0, 0.0, 1.0, 1.0, 1.0, 0.3, 0.4), ("h", "exon", 1, 9, "H", "c", 2.0, 2.0, 2.0, 2.0, 0.5, 0.5, 0.6)], f"{kinds}, {weights}")
    variant = "snv_pos bigint, snv_ref string, snv_alt string"
    pair = [("g", "exon", 1, 9, 5, "A", "G", "A", 0.9, 0.8, 0, 4), ("g", "exon", 1, 9, 12, "C", None, "B", 0.2, 0.8, 3, 3)]
    pairs = spark.createDataFrame(pair + pair[:1], f"{kinds}, {variant}, snv_hap string, h_A double, hat_Z_prob_revised double, exonic_distance bigint, genomic_distance bigint")
    raw = spark.createDataFrame([("g", "exon", 1, 9, 12, "C", None, 4, None, 2, 1, "t")], f"{kinds}, {variant}, raw_ref_present bigint, raw_ref_absent bigint, raw_alt_present bigint, raw_alt_absent bigint, raw_test_type string")
    context = spark.createDataFrame([("g", 12, "C", None, 7, "A", "mine", "+"), ("g", 5, "A", "G", 7, "A", None, "-")], f"geneID string, {variant}, n_reads bigint, gene_major_hap string, snvID string, snv_expr_direction string")
    out = assembly.event_snv(events, pairs, raw, context, "s", "Bulk")
    assert out.columns == list(assembly.COLUMNS) and len(out.columns) == 68 and dict(out.dtypes) == assembly.COLUMNS
    got = {(r.geneID, r.event_type, r.snv_pos): r for r in out.collect()}
    assert len(got) == out.count() == 4
    a, b, none, other = got["g", "exon", 5], got["g", "exon", 12], got["g", "junction", None], got["h", "exon", None]
    assert (a.linked_snv_count, a.is_nearest_snv_for_event, b.is_nearest_snv_for_event, a.has_linked_snv) == (2, True, False, True)
    assert (a.snvID, b.snvID, none.snvID) == ("c:5:A:G", "mine", None) and (a.eventID, a.event_length) == ("exon:1-9", 8)
    assert (a.event_inclusion_frac_A, a.event_pref_hap, a.event_pref_major_minor, a.snv_event_direction, b.snv_event_direction) == (0.75, "A", "major", "promotes_event", "reduces_event")
    assert (b.raw_validation_available, b.raw_total_reads, b.raw_test_type, a.raw_validation_available, a.raw_total_reads) == (True, 7, "t", False, None)
    assert (none.event_inclusion_frac_A, none.event_pref_hap, none.linked_snv_count, none.has_linked_snv) == (None, None, 0, False)
    assert (other.event_pref_hap, other.n_reads, other.event_pref_major_minor, a.n_reads) == ("B", None, None, 7)
    bare = assembly.event_snv(events, None, None, None, "s", "Bulk")
    assert bare.count() == 3 and dict(bare.dtypes) == assembly.COLUMNS
    assert assembly.event_snv(events.limit(0), pairs, raw, context, "s", "Bulk").count() == 0


def test_matrices_equal_a_pivot(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"G{g}", f"cell{c}", f"i{i}", *[round(r.choice([0.0, 0.0, r.random()]), 3) for _ in range(4)]) for g in range(4) for c in range(9) for i in range(2) if r.random() < 0.7]
    counts = spark.createDataFrame(rows, "geneName string, Cell string, Isoform string, hapA double, hapB double, hapA_phasable double, hapB_phasable double")
    cells = spark.createDataFrame([(f"cell{c}", None if c == 8 else "a/b" if c % 2 else "x y") for c in range(9)], "Cell string, CellType string")
    assert matrices.cell_types(cells) == ["Bulk", "a/b", "x y"]
    names = matrices.write_count_matrices(counts, str(tmp_path), cells)
    assert len(names) == 12 and {f"count_mat_{t}" for t in matrices.TAGS} <= set(names)
    table = pd.DataFrame(rows, columns=counts.columns)
    for level, by in (("gene", ["geneName"]), ("transcript", ["geneName", "Isoform"])):
        for suffix in ("", "_phasable"):
            want = {}
            for h in ("hapA", "hapB"):
                for key, v in table.groupby(["Cell", *by])[f"{h}{suffix}"].sum().items():
                    if v:
                        want[key[0], "_".join([*key[1:], h])] = v
            for name, own in ((f"count_mat_{level}{suffix}", lambda c: True), (f"count_mat_{level}{suffix}_ct_a_b", lambda c: int(c[4:]) % 2)):
                lines = [x for f in sorted((tmp_path / name / "matrix").glob("part-*")) for x in f.read_text().splitlines()]
                mine = {k: v for k, v in want.items() if own(k[0])}
                assert lines[0] == matrices.HEADER and lines[1] == f"{len({c for c, _ in mine})} {len({f for _, f in want})} {len(mine)}"
                ids = {n: {x[0]: x[1] for x in spark.read.parquet(str(tmp_path / name / n)).collect()} for n in ("rows", "columns")}
                assert ids["rows"] == {c: k + 1 for k, c in enumerate(sorted({c for c, _ in mine}))} and ids["columns"] == {f: k + 1 for k, f in enumerate(sorted({f for _, f in want}))}
                body = {tuple(map(int, x.split()[:2])): float(x.split()[2]) for x in lines[2:]}
                assert body.keys() == {(ids["rows"][c], ids["columns"][f]) for c, f in mine} and all(math.isclose(body[ids["rows"][c], ids["columns"][f]], v) for (c, f), v in mine.items())
                back = {(x.Cell, x.feature): x.value for x in matrices.read_matrix(spark, str(tmp_path / name)).collect()}
                assert back.keys() == mine.keys()


def test_steps_of_the_chain(spark, called):
    _, _, frame, regions, tiles = called
    sites, seen = (x.cache() for x in calling.call_sites(frame, regions, tiles, 50, depth=6, alt=1, het=0.3))
    exons = spark.createDataFrame([("g1", 0, 150), ("g1", 200, 250)], "geneID string, s bigint, e bigint")
    limits = chain.Limits(alt=1, depth=6, het=0.9, per_kilobase=20.0)
    steps = chain.chained_filters(sites, seen, exons, limits, tiles=tiles, tile=50, scorer=features.Logistic({"depth": 0.01}, 0.0))
    assert list(steps) == ["depth", "quality", "het", "stretch", "cluster", "scored"]
    rows = {n: {(x.geneID, x.pos): x for x in d.collect()} for n, d in steps.items()}
    assert rows["depth"].keys() == rows["quality"].keys() and all(rows[b].keys() <= rows[a].keys() for a, b in zip(rows, list(rows)[1:], strict=False))
    own = sorted((x for x in rows["quality"].values() if x.geneID == "g1"), key=lambda x: (-x.het_prob, x.pos))
    level = next(t for t in (0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5) if own[0].het_prob >= t)
    assert rows["het"].keys() == {("g1", x.pos) for x in own[:4] if x.het_prob >= level}  # 200 bases of exons: four sites; g2 has none
    strict = chain.chained_filters(sites, seen, exons, chain.Limits(alt=1, depth=6, het=0.9, fallback=False))
    assert {(x.geneID, x.pos) for x in strict["het"].collect()} == {k for k, x in rows["quality"].items() if x.het_prob >= 0.9}
    free = chain.chained_filters(sites, seen, exons, chain.Limits(alt=1, depth=6, het=-1.0))
    assert free["het"].count() == len(rows["quality"])
    some = sorted(rows["depth"])[:3]
    trusted = spark.createDataFrame([("c1", p, 0.5, 1) for _, p in some], "chrom string, pos bigint, trust double, depth int")
    kept = chain.chained_filters(sites, seen, exons, limits, confidence=trusted)
    assert list(kept) == ["depth", "quality", "trusted"] and {x.pos for x in kept["trusted"].collect()} == {p for _, p in some} and "trust" in kept["trusted"].columns


def test_gene_table_signs_effects(spark):
    variants = spark.createDataFrame([("g", "c", 5, "A", "G", 0.9), ("g", "c", 6, "A", None, 0.5), ("h", "c", 7, "A", "G", None), ("no", "c", 8, "C", "T", 0.8)], "geneID string, chrom string, pos bigint, ref string, alt string, h_A double")
    effects = spark.createDataFrame([("g", 9, "A", 1.5, "B", -0.5), ("h", 4, None, 2.0, None, 0.1)], "geneID string, n_reads bigint, gene_major_hap string, es_ase double, dominant_isoform_pref_hap string, es_astu double")
    out = assembly.gene_snv(variants, effects, "s", "T")
    assert dict(out.dtypes) == assembly.GENE_SNV and len(out.columns) == 52
    got = {r.snv_pos: r for r in out.collect()}
    told = lambda r: (r.snv_hap, r.snv_on_minor_hap, r.snv_expr_direction, r.snv_es_ase_signed, r.snv_astu_direction, r.snv_es_astu_signed)
    assert told(got[5]) == ("A", False, "+", 1.5, "-", 0.5) and told(got[6]) == ("B", True, "-", -1.5, "+", -0.5)
    assert told(got[7]) == ("B", None, None, None, None, None) and told(got[8]) == ("A", None, None, None, None, None)
    assert (got[5].snvID, got[6].snvID, got[8].n_reads, got[7].CellType) == ("c:5:A:G", None, None, "T")
