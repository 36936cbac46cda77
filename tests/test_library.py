"""Columns, operators, readers and the queries' SQL twins."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from phasewell.functions import alleles, intervals, tests_of_fit
from phasewell.operators import downstream, phasing, pileup
from phasewell.plans import catalog
from phasewell.sources import readers, writers

SF = "/root/testdata/sf0.001"
IV = "array<struct<s:bigint,e:bigint>>"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_every_oracle_names_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "customer", "supplier", "nation", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = catalog.QUERIES[name](spark, SF)
    cursor = con.execute(catalog.ORACLES[name])
    place = {c[0]: k for k, c in enumerate(cursor.description)}
    want = [[row[place[c]] for c in got.columns] for row in cursor.fetchall()]
    cell = lambda v: "" if v is None or v != v else str(v) if isinstance(v, (bool, str)) else round(float(v), 4)
    key = lambda rows: sorted((tuple(map(cell, r)) for r in rows), key=str)
    assert set(place) == set(got.columns) and key(got.collect()) == key(want)


def test_read_names(spark):
    df = spark.createDataFrame([("m1/1/ccs_1500",), ("ont_12",), (None,)], "n string")
    assert [r[0] for r in df.select(alleles.canonical_read_name(F.col("n"))).collect()] == ["m1/1/ccs", "ont_12", None]


def test_phred(spark):
    df = spark.createDataFrame([(10.0,), (None,), (float("nan"),), (-5.0,)], "q double")
    assert [round(r[0], 6) for r in df.select(alleles.phred_error(F.col("q"))).collect()] == [0.1, 0.25, 0.25, 1.0]


def test_het_posterior_against_binomials(spark):
    d, n, e, p = 30, 12, 0.01, (0.6, 0.1, 0.3)
    like = [p[0] * 0.5**d, p[1] * (1 - e) ** (d - n) * e**n, p[2] * e ** (d - n) * (1 - e) ** n]
    got = one(spark, x=alleles.het_posterior(F.lit(d), F.lit(n), e, p))["x"]
    assert math.isclose(got, like[0] / sum(like), rel_tol=1e-9)


def test_cigar_spans(spark):
    # 3S 10M 100N 5M 2D 4M 1I 6M
    cigar = F.expr("array(named_struct('op',4,'len',3),named_struct('op',0,'len',10),named_struct('op',3,'len',100),named_struct('op',0,'len',5),named_struct('op',2,'len',2),named_struct('op',0,'len',4),named_struct('op',1,'len',1),named_struct('op',0,'len',6))")
    r = one(spark, i=intervals.intron_spans(cigar, F.lit(50)), b=intervals.aligned_blocks(cigar, F.lit(50)))
    assert [tuple(x) for x in r["i"]] == [(60, 160)]
    assert [tuple(x) for x in r["b"]] == [(50, 60), (160, 165), (167, 171), (171, 177)]


def test_merge_and_overlap(spark):
    iv = F.expr(f"cast(array(named_struct('s',5,'e',9),named_struct('s',0,'e',3),named_struct('s',3,'e',4),named_struct('s',7,'e',7)) as {IV})")
    r = one(spark, m=intervals.merge_intervals(iv), o=intervals.overlap_bp(F.lit(2), F.lit(8), iv), g=intervals.merge_intervals(iv, 1))
    assert [tuple(x) for x in r["m"]] == [(0, 4), (5, 9)] and r["o"] == 5 and [tuple(x) for x in r["g"]] == [(0, 9)]


@pytest.mark.parametrize(("blocks", "introns", "kind", "event", "want"), [
    ([(0, 100)], [], "exon", (40, 60), "include"), ([(0, 40), (60, 100)], [(40, 60)], "exon", (40, 60), "skip"), ([(45, 50)], [], "exon", (40, 80), "unobserved"),
    ([(0, 50), (150, 200)], [(50, 150)], "junction", (50, 150), "include"), ([(0, 50), (150, 200)], [(50, 150)], "junction", (50, 169), "include"), ([(0, 200)], [], "junction", (50, 150), "skip"), (None, None, "exon", (1, 9), "unobserved"),
])
def test_event_judgement(spark, blocks, introns, kind, event, want):
    df = spark.createDataFrame([(blocks, introns)], f"b {IV}, i {IV}")
    assert df.select(intervals.judge_event(F.lit(kind), F.lit(event[0]), F.lit(event[1]), F.col("b"), F.col("i"))).first()[0] == want


@pytest.mark.parametrize(("window", "at", "kmer", "want"), [("CGTAAAAACGT", 5, 1, True), ("CGTAAAAACGT", 9, 1, False), ("CGTAAAACGT", 5, 1, False), ("TGACACACTG", 4, 2, True), ("AAGAAGAAGT", 4, 3, True), ("AC", 1, 1, False)])
def test_repeats(spark, window, at, kmer, want):
    assert one(spark, x=intervals.in_repeat(F.lit(window), F.lit(at), kmer))["x"] is want


def test_tests_of_fit(spark):
    df = spark.createDataFrame([(3.8414588, 1), (5.9914645, 2), (7.8147279, 3), (0.0, 4)], "x double, df int")
    got = [r[0] for r in df.select(tests_of_fit.chi2_sf(F.col("x"), F.col("df"))).collect()]
    assert np.allclose(got, [0.05, 0.05, 0.05, 1.0], atol=1e-6)
    r = one(spark, e=tests_of_fit.chi2_sf_even(F.lit(9.487729), F.lit(4)), b=tests_of_fit.binomial_half(F.lit(2), F.lit(10)), c=tests_of_fit.chi2_2x2(F.lit(10), F.lit(20), F.lit(30), F.lit(40)), z=tests_of_fit.chi2_2x2(F.lit(0), F.lit(0), F.lit(3), F.lit(4)))
    assert math.isclose(r["e"], 0.05, abs_tol=1e-6) and math.isclose(r["b"], 112 / 1024, rel_tol=1e-9) and math.isclose(r["c"], 100 * (10 * 40 - 20 * 30) ** 2 / (30 * 70 * 40 * 60), rel_tol=1e-12) and r["z"] is None


def test_fdr_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, None), (4, 0.03)], "i int, p double").withColumn("g", F.lit(1))
    got = {r["i"]: r["q"] for r in tests_of_fit.bh_fdr(df, "p", "q", ["g"], ["i"]).collect()}
    assert got[3] is None and np.allclose([got[1], got[2], got[4]], [0.03, 0.04, 0.04])


def test_pileup_from_alignments(spark):
    q = [30] * 12
    rows = [("s", "r1", "c", 10, 0, 60, [(0, 12)], "ACGTACGTACGT", q), ("s", "r2", "c", 10, 0, 60, [(0, 5), (2, 2), (0, 5)], "ACGTACCTAC", q[:10]), ("s", "r3", "c", 10, 256, 60, [(0, 12)], "ACGTACGTACGT", q), ("s", "r4", "c", 10, 0, 10, [(0, 12)], "TTTTTTTTTTTT", q)]
    reads = pileup.primary(spark.createDataFrame(rows, readers.ALIGNMENTS)).withColumn("geneID", F.lit("g"))
    bases = pileup.explode_bases(reads)
    assert bases.where("is_del").count() == 2
    tiles = spark.createDataFrame([("c", 0, "N" * 10 + "ACGTACGTAC"), ("c", 20, "GTNN")], "chrom string, start bigint, seq string")
    seen = pileup.usable(pileup.with_reference(bases, tiles, 20))
    assert seen.where("mapq < 20").count() == 0
    counts = {r["pos"]: (r["ref_count"], r["alt_count"]) for r in pileup.pileup_counts(seen, ["pos"]).collect()}
    assert counts == {17: (1, 1)} or all(a >= 0 for a, _ in counts.values())
    sites = spark.createDataFrame([("s", "g", "c", 15)], "sample string, geneID string, chrom string, pos bigint")
    assert pileup.deletion_counts(bases, sites).first()["del_count"] == 1


def simulated(seed: int, n: int = 120, m: int = 6):
    r = np.random.default_rng(seed)
    hap = r.random(n) < 0.7
    side = r.random(m) < 0.5
    error = r.uniform(0.01, 0.05, (n, m))
    alt = np.where(r.random((n, m)) < error, ~(hap[:, None] == side[None, :]), hap[:, None] == side[None, :])
    code = np.where(r.random((n, m)) < 0.2, -1, alt.astype(int)).astype(np.int8)
    return code, np.where(code < 0, 1.0, error), hap, side


@pytest.mark.parametrize("seed", range(4))
def test_phasing_recovers_haplotypes(seed):
    code, error, hap, side = simulated(seed)
    out = phasing.phase(code, error, np.full(code.shape[1], 0.95))
    reads = ((out.hat > 0.5) == hap)[out.phasable].mean()
    assert max(reads, 1 - reads) > 0.95
    sites = ((out.h > 0.5) == side).mean()
    assert max(sites, 1 - sites) == 1
    assert abs(max(out.alpha, 1 - out.alpha) - max(hap.mean(), 1 - hap.mean())) < 0.05
    null = phasing.phase(code, error, np.full(code.shape[1], 0.95), fixed_alpha=0.5)
    assert out.loglik >= null.loglik - 1e-3


def plain_em(code, error, score, rounds):
    """The EM in plain loops over reads and sites, h where the mixture is likeliest on a fine grid; starts as the kernel does."""
    n, m = code.shape
    h = phasing._first_phase(((code == 1).T @ (code == 1).astype(float)), np.random.default_rng(42))
    marker, alpha, hat = np.array(score, float), 0.5, np.zeros(n)
    grid = np.linspace(0, 1, 20_001)

    def seen(i, j, share):
        e = error[i, j]
        return {0: share * e / 3 + (1 - share) * (1 - e), 1: share * (1 - e) + (1 - share) * e / 3, 2: 2 * e / 3 + 0 * share}[code[i, j]]

    def noise(i, j):
        return {0: 1 - error[i, j], 1: error[i, j] / 3, 2: 2 * error[i, j] / 3}[code[i, j]]

    for _ in range(rounds):
        for i in range(n):
            a, b = alpha, 1 - alpha
            for j in range(m):
                if code[i, j] >= 0:
                    a *= marker[j] * 0.5 * seen(i, j, h[j]) + (1 - marker[j]) * noise(i, j)
                    b *= marker[j] * 0.5 * seen(i, j, 1 - h[j]) + (1 - marker[j]) * noise(i, j)
            hat[i] = a / (a + b)
        alpha, old_h = hat.mean(), h.copy()
        for j in range(m):
            own = [i for i in range(n) if code[i, j] >= 0]
            odds = np.log(marker[j] / (1 - marker[j]))
            odds += sum(np.log(0.5 * (hat[i] * seen(i, j, old_h[j]) + (1 - hat[i]) * seen(i, j, 1 - old_h[j])) / noise(i, j)) for i in own)
            marker[j] = 1 / (1 + np.exp(-odds))
            h[j] = grid[sum(np.log(marker[j] * 0.5 * (hat[i] * seen(i, j, grid) + (1 - hat[i]) * seen(i, j, 1 - grid)) + (1 - marker[j]) * noise(i, j)) for i in own).argmax()]
    return alpha, h, marker, hat


@pytest.mark.parametrize("seed", range(3))
def test_kernel_equals_plain_loops(seed):
    code, error, *_ = simulated(seed, 40, 4)
    code[:, :2][np.random.default_rng(seed).random((40, 2)) < 0.1] = 2
    error = np.where(code < 0, 1.0, np.minimum(error, 0.05))
    out = phasing.phase(code, error, np.full(4, 0.6), max_iter=3, tol=0)
    assert out.rounds == 3 and out.phasable.all()
    alpha, h, marker, hat = plain_em(code, error, np.full(4, 0.6), 3)
    assert abs(alpha - out.alpha) < 1e-3
    for got, want in ((out.h, h), (out.marker, marker), (out.hat, hat)):
        assert np.abs(got - want).max() < 1e-3


@pytest.mark.parametrize("distance", [0, 7, 50])
def test_link_equals_all_pairs(spark, distance):
    """Against every site and event of a gene; a gene without exons links nothing."""
    r = np.random.default_rng(distance)
    genes = ["g", "h", "none"]
    exons = sorted({(g, int(s), int(s) + int(r.integers(1, 90))) for g in genes[:2] for s in r.integers(0, 1500, 8)})
    events = sorted({(g, "c", "exon", int(s), int(s) + int(r.integers(0, 300))) for g in genes for s in r.integers(0, 1500, 12)})
    sites = sorted({(g, "c", int(p), "A", "G") for g in genes for p in r.integers(0, 1700, 25)})
    before = lambda g, p: sum(max(0, min(p - s, e - s)) for x, s, e in exons if x == g)
    want = set()
    for g, _, _, s, e in events:
        for x, _, p, _, _ in sites:
            if g == x != "none":
                d = 0 if s <= p <= e else min(abs(before(g, p) - before(g, s)), abs(before(g, p) - before(g, e)))
                want |= {(g, s, e, p, d)} if d <= distance else set()
    frame = spark.createDataFrame
    out = downstream.link_snvs(frame(sites, "geneID string, chrom string, pos bigint, ref string, alt string"), frame(events, "geneID string, chrom string, event_type string, s bigint, e bigint"), frame(exons, "geneID string, s bigint, e bigint"), distance).collect()
    got = [(x["geneID"], x["s"], x["e"], x["pos"], x["exonic_distance"]) for x in out]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(x["is_nearest"] for x in out) == len({x[:3] for x in want})


def test_native_estep_equals_kernel(spark):
    code, error, *_ = simulated(9, 40, 4)
    h, marker = np.array([0.9, 0.1, 0.8, 0.3]), np.array([0.9, 0.8, 0.7, 0.95])
    out = phasing.phase(code, error, marker, frozen=(h, marker), fixed_alpha=0.4, max_iter=1)
    rows = [("g", str(i), str(j), int(code[i, j]), float(error[i, j])) for i in range(40) for j in range(4) if code[i, j] >= 0]
    codes = spark.createDataFrame(rows, "geneID string, Read string, snv_id string, r int, pi double")
    sites = spark.createDataFrame([("g", str(j), float(h[j]), float(marker[j])) for j in range(4)], "geneID string, snv_id string, h_A double, h_m double")
    got = {int(r["Read"]): r["hat_I"] for r in phasing.read_posterior(codes, sites, F.lit(0.4), ["geneID"]).collect()}
    assert all(abs(got[i] - out.hat[i]) < 1e-9 for i in got)
    assert abs(phasing.observed_loglik(codes, sites, F.lit(0.4), ["geneID"]).first()["loglik"] - out.loglik) < 1e-6


def test_phase_genes_reports_errors_and_rows(spark):
    code, error, *_ = simulated(3, 30, 3)
    rows = [("g", str(i), str(j), int(code[i, j]), float(error[i, j]), 0.9) for i in range(30) for j in range(3) if code[i, j] >= 0]
    reads, sites = phasing.phase_genes(spark.createDataFrame(rows, "geneID string, Read string, snv_id string, r int, pi double, score double"), ["geneID"])
    assert sites.count() == 3 and all(abs(r["hat_I"] + r["hat_I_B"] - 1) < 2e-3 for r in reads.collect())


def test_a_failing_gene_is_not_left_out(spark):
    rows = [(g, str(i), str(j), (i + j) % 2, 0.02, score) for g, score in (("g", "0.9"), ("h", "bad")) for i in range(6) for j in range(2)]
    codes = spark.createDataFrame(rows, "geneID string, Read string, snv_id string, r int, pi double, score string")
    for view in phasing.phase_genes(codes, ["geneID"]):
        with pytest.raises(Exception, match="phasing of .*'h'.* failed"):
            view.collect()
    assert phasing.phase_genes(codes.where("geneID = 'g'"), ["geneID"])[1].count() == 2


def test_keep_mask_branches():
    keep = lambda x, **k: phasing.keep_mask(np.array(x), **k).tolist()
    assert keep([0.95, 0.92, 0.1], min_keep=2) == [True, True, False]
    assert keep([0.95, 0.5, 0.1], min_keep=2) == [True, True, False]
    assert keep([0.8, 0.75, 0.2], min_keep=2) == [True, True, False]
    assert keep([0.5, 0.48, 0.46], min_keep=2) == [True, True, False]
    # four at least by default, in every branch, and no more than asked
    assert keep([0.95, 0.1, 0.2, 0.3, 0.4, 0.5]) == [True, False, False, True, True, True]
    assert keep([0.8, 0.75, 0.2, 0.19, 0.18, 0.17]) == [True, True, True, True, False, False]
    assert keep([0.99] * 6, max_keep=5).count(True) == 5 and keep([0.5, 0.49, 0.48, 0.47, 0.46, 0.45], max_keep=4, min_keep=1).count(True) == 3
    assert keep([]) == []


def test_gap_mask_keeps_all_without_a_gap():
    assert phasing.gap_mask(np.array([0.5, 0.45, 0.44, 0.43, 0.42])).all()
    assert phasing.gap_mask(np.array([0.9, 0.88, 0.87, 0.86, 0.3, 0.2])).tolist() == [True] * 4 + [False] * 2
    assert phasing.gap_mask(np.array([0.9, 0.1, 0.09, 0.08, 0.07])).sum() == 4


def test_first_phase_finds_uneven_groups():
    """Nine sites on one haplotype and three on the other: no half and half split."""
    r = np.random.default_rng(5)
    hap, side = r.random(200) < 0.5, np.arange(12) < 9
    alt = ((hap[:, None] == side[None, :]) & (r.random((200, 12)) < 0.95)).astype(float)
    start = phasing._first_phase(phasing._together(*np.nonzero(alt), *alt.shape), r)
    told = np.abs(start - 0.5) > 0.1
    assert told.sum() >= 6 and len({(bool(x), bool(s)) for x, s in zip(start[told] > 0.5, side[told], strict=True)}) <= 2


def test_most_imbalanced_gives_to_the_larger_share(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0, [2.0, 5.0]), (2, 10.0, 5.0, [3.0]), (3, 6.0, 6.0, [2.0, 2.0]), (4, 4.0, 0.0, [1.0]), (5, 1.0, 1.0, [0.0])], "i int, totalA double, totalB double, missing array<double>")
    got = {r["i"]: (r["_imbalance"]["a"], r["_imbalance"]["b"], len(r["_imbalance"]["rows"])) for r in downstream.most_imbalanced(df).collect()}
    assert got == {1: (8, 3, 2), 2: (10, 8, 1), 3: (8, 8, 2), 4: (5, 0, 1), 5: (1, 1, 0)}


def test_pooled_isoforms_carry_the_prefix(spark):
    df = spark.createDataFrame([("g", "t", 90.0, 90.0), ("g", "novel1", 1.0, 1.0), ("g", "u", 2.0, 2.0)], "geneID string, Isoform string, hapA double, hapB double")
    name = lambda **k: {r["Isoform"] for r in downstream.pooled_isoforms(df, ["geneID"], prefix="geneID", **k).collect()}
    assert name() == {"t", "g_Other"} and name(pool_novel=True, share=0.005) == {"t", "g_Novel", "u"}


def test_overlap_sums_make_no_pairs_or_lists(spark):
    r = np.random.default_rng(2)
    rows = [(g, int(s), int(s + n)) for g in "ab" for s, n in zip(r.integers(0, 300, 40), r.integers(0, 60, 40), strict=True)]
    df = spark.createDataFrame(rows, "geneID string, s bigint, e bigint")
    out = downstream.overlap_sums(df, df, ["geneID"], width=32)
    want = sorted((g, s, e, sum(max(0, min(e, y) - max(s, x)) for h, x, y in rows if h == g)) for g, s, e in rows)
    assert sorted(tuple(x) for x in out.select("geneID", "s", "e", "bp").collect()) == want
    plan = catalog.range_overlap_bp(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_readers(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("Read\tgeneName\tgeneID\tgeneChr\tIsoform\tCell\tUmi\tKeep\nm/1/ccs_5\tA\tg\tc\tt\tx\tu\t1\nm/2/ccs\tA\tg\tc\tt\tx\tu\t0\n")
    assert [r["Read"] for r in readers.read_mapping(spark, str(tmp_path / "m.tsv"), "s").collect()] == ["m/1/ccs"]
    (tmp_path / "a.gtf").write_text('#x\nc\ts\texon\t11\t20\t.\t+\t.\tref_gene_id "no"; gene_id "g"; transcript_id "t"; gene_name "A";\nc\ts\tgene\t1\t9\t.\t+\t.\tgene_id "g";\nc\ts\texon\t9\t8\t.\t+\t.\tgene_id "g";\n')
    r = readers.gtf_exons(spark, str(tmp_path / "a.gtf")).collect()
    assert [(x["geneID"], x["s"], x["e"]) for x in r] == [("g", 10, 20)]
    (tmp_path / "r.fa").write_text(">c1 x\nACGT\nAC\n>c2\nGG\n")
    tiles = {(x["chrom"], x["start"]): x["seq"] for x in readers.reference_tiles(spark, str(tmp_path / "r.fa"), 4).collect()}
    assert tiles == {("c1", 0): "ACGT", ("c1", 4): "AC", ("c2", 0): "GG"}


def test_matrix_market(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("a", "y", 0.0)], "r string, c string, v double")
    writers.matrix_market(df, str(tmp_path / "m"), "r", "c", "v")
    assert spark.read.text(str(tmp_path / "m/matrix")).count() == 2
    assert sorted(x["_i"] for x in spark.read.csv(str(tmp_path / "m/rows"), header=True).collect()) == ["1", "2"]


def test_collapse_suffixes(spark):
    df = spark.createDataFrame([(" A", "a", 1), ("b", "c", 2)], "n_x string, n_y string, v int")
    assert [tuple(r) for r in downstream.collapse_suffixes(df, ["n"]).select("v").collect()] == [(1,)]


def linked_reads(seed: int, sites: int, reads: int, width: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(read, site) of alternative alleles: a read covers some neighbouring sites and shows those of its haplotype."""
    r = np.random.default_rng(seed)
    side, rows = r.random(sites) < 0.5, []
    for i in range(reads):
        at, hap = r.integers(0, sites), r.random() < 0.5
        rows += [(i, first + j) for j in range(at, min(sites, at + width)) if (side[j] == hap) != (r.random() < 0.04)]
    read, site = np.array(rows).T
    return read, site


@pytest.mark.parametrize("shape", [(30, 400, 10), (150, 700, 25), (260, 2500, 12)])
def test_first_phase_without_a_table_of_sites(shape):
    """The same split as by the table, whichever side comes first, from reads and from pairs of sites."""
    read, site = linked_reads(7, *shape)
    m, n = shape[0] + 3, shape[1]  # three sites are never alternative
    table = phasing._together(read, site, n, m)
    want = phasing._first_phase(table.copy(), np.random.default_rng(42))
    got = phasing.first_phase_linked(read, site, np.ones(n), m, np.random.default_rng(42))
    flipped = np.where(np.abs(want - 0.5) > 0.1, 1 - want, want)
    assert np.allclose(got, want) or np.allclose(got, flipped)
    i, j = np.nonzero(np.triu(table, 1))
    by_pairs = phasing.first_phase_linked(np.tile(np.arange(len(i)), 2), np.append(i, j), table[i, j], m, np.random.default_rng(42))
    assert np.allclose(by_pairs, got)


def test_first_phase_of_pieces_and_of_no_links():
    a, b = linked_reads(1, 20, 200, 8), linked_reads(2, 30, 300, 8, first=20)
    read, site = np.append(a[0], 200 + b[0]), np.append(a[1], b[1])
    start = phasing.first_phase_linked(read, site, np.ones(500), 50, np.random.default_rng(42))
    for own in (start[:20], start[20:]):
        assert len({x > 0.5 for x in own if abs(x - 0.5) > 0.1}) == 1  # pieces stay whole
    lone = np.arange(5)
    want = phasing._first_phase(phasing._together(lone, lone, 5, 5), np.random.default_rng(42))
    assert np.array_equal(phasing.first_phase_linked(lone, lone, np.ones(5), 5, np.random.default_rng(42)), want)


def test_many_sites_need_no_table_of_sites():
    """A gene of 4500 steering sites: memory follows its 40000 observations, not sites x sites (162 MB a table)."""
    import tracemalloc

    r = np.random.default_rng(4)
    read, site = np.divmod(np.unique(r.integers(0, 20_000 * 4500, 40_000)), 4500)
    code, error = r.integers(0, 2, len(read)), 10 ** -r.uniform(1, 3, len(read))
    tracemalloc.start()
    out = phasing.phase_observed(read, site, code, error, 20_000, np.full(4500, 0.95), max_iter=5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.h.shape == (4500,) and np.isfinite(out.loglik) and peak < 60e6


def test_site_update_is_as_exact_as_halving():
    r = np.random.default_rng(8)
    site, fixed = r.integers(0, 200, 5000), r.uniform(0, 0.6, 5000)
    rising = r.uniform(-1, 1, 5000) * np.where(r.random(5000) < 0.1, 0, fixed)
    lo, hi = np.zeros(200), np.ones(200)
    for _ in range(60):
        mid = (lo + hi) / 2
        up = np.bincount(site, rising / np.maximum(1e-300, fixed + rising * mid[site]), 200) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    assert np.abs(phasing._best_h(site, fixed, rising, 200) - (lo + hi) / 2).max() < 1e-12


def test_a_gene_comes_in_batches(spark):
    """Names are numbered over all batches of a gene; reads without a steering site and duplicates stay as they were."""
    r = np.random.default_rng(6)
    rows = [("g", 7, f"r{i}", f"s{j}", int(r.integers(-1, 3)), float(10 ** -r.uniform(1, 3)), [0.95, 0.93, 0.92, 0.91, 0.2, 0.1, 0.15][j]) for i in range(40) for j in range(7) if r.random() < 0.4]
    rows += rows[:5]
    codes = spark.createDataFrame(rows, "geneID string, part int, Read string, snv_id string, r int, pi double, score double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        reads, sites = (x.toPandas() for x in phasing.phase_genes(codes, ["geneID", "part"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    names, i = np.unique([x[2] for x in rows], return_inverse=True)
    ids, j = np.unique([x[3] for x in rows], return_inverse=True)
    code, error, score = np.full((len(names), 7), -1), np.ones((len(names), 7)), np.zeros(7)
    for a, b, x in zip(i, j, rows, strict=True):
        code[a, b], error[a, b], score[b] = x[4], x[5], x[6]
    want = phasing.phase(code, error, score)
    assert len(reads) == len(names) and len(sites) == 7 and set(sites["part"]) == {7}
    assert np.allclose(sites.set_index("snv_id").loc[ids, "h_A"], want.h) and np.allclose(sites["ll_alt"], want.loglik)
    assert np.allclose(reads.set_index("Read").loc[names, "hat_I"], want.hat, atol=6e-4) and (reads["reads_phasable"] == 0).any() == (~want.phasable).any()
