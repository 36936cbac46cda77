"""From aligned reads to candidate sites and EM input.

One scan of the alignments gives a long table of observed bases; candidate sites come from an
aggregation of it, and their observations from a semi-join with it, instead of a second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alleles import het_posterior, phred_error
from ..functions.intervals import aligned_blocks, intron_spans, overlap

#: Flags of unmapped, secondary and supplementary alignments.
DROPPED_FLAGS = 0x904
READ_ENDS = 3
STEP1_PRIORS = (0.6, 0.1, 0.3)


def primary(alignments: DataFrame) -> DataFrame:
    """One primary alignment per read name (S10): mapped, neither secondary nor supplementary."""
    first = Window.partitionBy("sample", "qname").orderBy("chrom", "pos", "flag")
    kept = alignments.where(F.col("flag").bitwiseAND(F.lit(DROPPED_FLAGS)) == 0)
    return kept.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def reads_in_genes(alignments: DataFrame, genes: DataFrame, bin_size: int = 100_000) -> DataFrame:
    """Alignments with each gene whose region they overlap.

    Regions are cut into bins, so that the range condition rides on a hash join.
    """
    end = F.col("pos") + F.aggregate("cigar", F.lit(0).cast("bigint"), lambda a, x: F.when(x["op"].isin(0, 2, 3, 7, 8), a + x["len"]).otherwise(a))
    reads = alignments.withColumn("_end", end).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("pos") / bin_size), F.floor(F.col("_end") / bin_size))))
    regions = genes.select("geneID", F.col("geneChr").alias("chrom"), "geneStart", "geneEnd").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("geneStart") / bin_size), F.floor(F.col("geneEnd") / bin_size))))
    met = reads.join(regions, ["chrom", "_bin"]).where("pos < geneEnd AND _end > geneStart")
    # the bin in which both have begun reports the pair
    return met.where(F.col("_bin") == F.floor(F.greatest("pos", "geneStart") / bin_size)).drop("_bin", "_end", "geneStart", "geneEnd")


def read_blocks(alignments: DataFrame) -> DataFrame:
    """Aligned blocks and introns of each read of each gene."""
    return alignments.select("sample", "geneID", F.col("qname").alias("Read"), aligned_blocks(F.col("cigar"), F.col("pos")).alias("blocks"), intron_spans(F.col("cigar"), F.col("pos")).alias("introns"))


def merged_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks over all samples; the last sample in order wins for a read name (A5)."""
    last = Window.partitionBy("geneID", "Read").orderBy(F.col("sample").desc())
    return blocks.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def pieces(alignments: DataFrame) -> DataFrame:
    """One row per CIGAR operation that covers reference positions, with its part of sequence and qualities.

    p and q are its first place on the reference and the read, n its length; deletions have no sequence.
    """
    state = F.expr("named_struct('p', pos, 'q', 0L, 'out', cast(array() as array<struct<p:bigint,q:bigint,n:bigint,del:boolean>>))")

    def step(s: Column, x: Column) -> Column:
        op, n = x["op"], x["len"].cast("bigint")
        ref = F.when(op.isin(0, 2, 3, 7, 8), n).otherwise(F.lit(0).cast("bigint"))
        read = F.when(op.isin(0, 1, 4, 7, 8), n).otherwise(F.lit(0).cast("bigint"))
        piece = F.struct(s["p"].alias("p"), s["q"].alias("q"), n.alias("n"), (op == 2).alias("del"))
        return F.struct((s["p"] + ref).alias("p"), (s["q"] + read).alias("q"), F.when(op.isin(0, 2, 7, 8), F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"))

    each = alignments.withColumn("_piece", F.explode(F.aggregate("cigar", state, step, lambda s: s["out"])))
    return each.select(
        "sample", "geneID", "chrom", F.col("qname").alias("Read"), "mapq", F.col("flag").bitwiseAND(F.lit(16)).alias("rev"), F.char_length("seq").alias("read_len"),
        F.col("_piece.p").alias("p"), F.col("_piece.q").alias("q"), F.col("_piece.n").alias("n"), F.col("_piece.del").alias("del"),
        F.when(~F.col("_piece.del"), F.substring("seq", F.col("_piece.q").cast("int") + 1, F.col("_piece.n").cast("int"))).alias("s"),
        F.when(~F.col("_piece.del"), F.slice("qual", F.col("_piece.q").cast("int") + 1, F.col("_piece.n").cast("int"))).alias("b"),
    )


def bases_at(cut: DataFrame, i: Column, *more: str) -> DataFrame:
    """The base of a piece at its i-th place."""
    i = i.cast("int")
    return cut.select(
        "sample", "geneID", "chrom", (F.col("p") + i).alias("pos"), "Read", F.when(~F.col("del"), F.col("q") + i).alias("qpos"),
        F.upper(F.substring("s", i + 1, F.lit(1))).alias("base"), F.get("b", i).alias("baseq"), "mapq", "read_len", (F.col("rev") != 0).cast("int").alias("is_reverse"), F.col("del").alias("is_del"), *more,
    )


def explode_bases(alignments: DataFrame) -> DataFrame:
    """One row per reference position that a read covers.

    Deletions give a row without a base. Sequence and qualities are cut by CIGAR operation first,
    so that each row costs one slice of its own operation.
    """
    at = pieces(alignments).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return bases_at(at, F.col("i"))


def usable(bases: DataFrame, ref: str = "ref", min_baseq: int = 5, min_mapq: int = 20, ends: int = READ_ENDS) -> DataFrame:
    """Base-level filter (F1): quality, mapping, A/C/G/T; mismatches near a read's end go."""
    near_end = F.least(F.col("qpos"), F.col("read_len") - 1 - F.col("qpos")) < ends
    ok = ~F.col("is_del") & (F.col("baseq") >= min_baseq) & (F.col("mapq") >= min_mapq) & F.col("base").isin("A", "C", "G", "T")
    return bases.where(ok & ~((F.col("base") != F.col(ref)) & near_end))


def with_reference(bases: DataFrame, tiles: DataFrame, tile: int) -> DataFrame:
    """The reference base of each row, from tiles (chrom, start, seq) of fixed length."""
    joined = bases.withColumn("start", F.floor(F.col("pos") / tile) * tile).join(tiles.select("chrom", "start", "seq"), ["chrom", "start"])
    return joined.withColumn("ref", F.upper(F.substring("seq", (F.col("pos") - F.col("start") + 1).cast("int"), F.lit(1)))).drop("seq", "start")


def pileup_counts(observed: DataFrame, by: list[str]) -> DataFrame:
    """Reference and other alleles per site (A1); sites without another allele go."""
    is_ref = F.col("base") == F.col("ref")
    counts = observed.groupBy(*by).agg(F.count_if(is_ref).alias("ref_count"), F.count_if(~is_ref).alias("alt_count"))
    depth = F.col("ref_count") + F.col("alt_count")
    return counts.where("alt_count > 0").withColumn("depth", depth).withColumn("alt_frac", F.col("alt_count") / F.col("depth"))


def candidates(counts: DataFrame, depth: int = 20, alt: int = 10, het: float = 0.99) -> DataFrame:
    """Depth and alt-count filter (F2, more than ``alt``) and the loose het prefilter."""
    kept = counts.where((F.col("depth") >= depth) & (F.col("alt_count") > alt)).withColumn("het_prob", het_posterior(F.col("depth"), F.col("alt_count"), 0.01, STEP1_PRIORS))
    return kept.where(F.col("het_prob") >= het * 0.8 / 0.99) if het > 0 else kept


def deletion_counts(bases: DataFrame, sites: DataFrame) -> DataFrame:
    """Deletions at candidate sites, whatever their quality (A2)."""
    keys = ["sample", "geneID", "chrom", "pos"]
    return bases.where("is_del").join(sites.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("del_count"))


def joint_sites(sites: DataFrame, keys: list[str]) -> DataFrame:
    """Sites over samples: sums of what each sample's thresholds let through (A3)."""
    summed = sites.groupBy(*keys).agg(F.sum("depth").alias("depth"), F.sum("alt_count").alias("alt_count"))
    return summed.withColumn("alt_frac", F.col("alt_count") / F.col("depth")).withColumn("het_prob", het_posterior(F.col("depth"), F.col("alt_count"), 0.01, STEP1_PRIORS))


def alt_vote(observed: DataFrame, site: list[str]) -> DataFrame:
    """Most frequent other base per site; ties: lowest mean error, then the alphabet."""
    votes = observed.where("base <> ref").groupBy(*site, "base").agg(F.count(F.lit(1)).alias("votes"), F.avg(phred_error(F.col("baseq"))).alias("mean_error"))
    order = Window.partitionBy(*site).orderBy(F.col("votes").desc(), "mean_error", "base")
    return votes.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n").withColumnRenamed("base", "alt")


def em_input(observed: DataFrame, alts: DataFrame, site: list[str], order: list[str]) -> DataFrame:
    """Allele codes and error probabilities, one row per read and site: the first by ``order``."""
    first = Window.partitionBy(*site, "Read").orderBy(*order)
    once = observed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    code = F.when(F.col("base") == F.col("ref"), 0).when(F.col("base") == F.col("alt"), 1).otherwise(2)
    return once.join(alts.select(*site, "alt"), site).select(*site, "Read", code.cast("tinyint").alias("r"), phred_error(F.col("baseq")).alias("pi"))


def variant_clusters(sites: DataFrame, by: list[str], k: int = 3, window: int = 20, escape: int = 150) -> DataFrame:
    """Drop sites among ``k`` neighbours within ``window`` bases unless well supported."""
    order = Window.partitionBy(*by).orderBy("pos")
    dense = (F.lead("pos", k - 1).over(order) - F.col("pos")) <= window
    marked = sites.withColumn("_start", F.coalesce(dense, F.lit(False)).cast("int"))
    inside = F.max("_start").over(order.rowsBetween(-(k - 1), 0))
    return marked.withColumn("_in", inside).where((F.col("_in") == 0) | (F.col("alt_count") >= escape)).drop("_start", "_in")


def het_filter(sites: DataFrame, by: list[str], threshold: float = 0.99) -> DataFrame:
    """Strict het filter (F4); negative switches it off."""
    return sites if threshold < 0 else sites.where(F.col("het_prob") >= threshold)


def het_fallback(sites: DataFrame, by: list[str], limit: str, threshold: float = 0.99, step: float = 0.05, lowest: float = 0.5) -> DataFrame:
    """The first threshold of the descent that leaves a site, then the best ``limit`` sites.

    The descent is closed form: the largest step at or below the group's best site. Steps above
    ``lowest`` only; the limit is a column of sites.
    """
    group = Window.partitionBy(*by)
    steps = [round(threshold - i * step, 10) for i in range(100) if round(threshold - i * step, 10) >= lowest]
    best = F.max("het_prob").over(group)
    level = F.array_max(F.filter(F.array(*[F.lit(x) for x in steps]), lambda t: t <= F.col("_best")))
    kept = sites.withColumn("_best", best).withColumn("_level", level).where("het_prob >= _level")
    rank = F.row_number().over(group.orderBy(F.col("het_prob").desc(), "pos"))
    return kept.withColumn("_rank", rank).where(F.col("_rank") <= F.col(limit)).drop("_best", "_level", "_rank")


def editing_sites(sites: DataFrame, known: DataFrame) -> DataFrame:
    """Drop known RNA-editing sites, A>G and T>C."""
    edits = known.where("(ref = 'A' AND alt = 'G') OR (ref = 'T' AND alt = 'C')").select("chrom", "pos", "ref", "alt")
    return sites.join(edits, ["chrom", "pos", "ref", "alt"], "left_anti")


def novel_intervals(exons: DataFrame, referenced: DataFrame, genes: DataFrame, share: float = 0.25) -> DataFrame:
    """Novel-only sub-exons of genes where they fill too much of the introns."""
    exon = exons.withColumn("len", F.col("e") - F.col("s"))
    novel = exon.join(referenced.select("geneID", "s", "e").distinct(), ["geneID", "s", "e"], "left_anti")
    known = exon.join(referenced.select("geneID", "s", "e").distinct(), ["geneID", "s", "e"], "left_semi")
    stats = genes.where(~F.col("geneID").startswith("gene_")).select("geneID", (F.col("geneEnd") - F.col("geneStart")).alias("span"))
    stats = stats.join(known.groupBy("geneID").agg(F.sum("len").alias("known_len")), "geneID", "left").join(novel.groupBy("geneID").agg(F.sum("len").alias("novel_len")), "geneID")
    intron = F.col("span") - F.coalesce("known_len", F.lit(0))
    leaky = stats.withColumn("intron_len", intron).where("intron_len > 0").where(F.col("novel_len") / F.col("intron_len") > share)
    return novel.join(leaky.select("geneID"), "geneID", "left_semi").select("geneID", "s", "e")


def outside_intervals(sites: DataFrame, intervals: DataFrame) -> DataFrame:
    """Sites of a gene in none of its intervals (F9); the gene is the equi key of the range join."""
    i = intervals.alias("i")
    return sites.alias("x").join(i, (F.col("x.geneID") == F.col("i.geneID")) & (F.col("x.pos") >= F.col("i.s")) & (F.col("x.pos") < F.col("i.e")), "left_anti")


def intronic_reads(blocks: DataFrame, exons: DataFrame, share: float = 0.6) -> DataFrame:
    """Reads whose aligned bases lie mostly outside their gene's exons."""
    block = blocks.select("sample", "geneID", "Read", F.explode("blocks").alias("b"))
    own = exons.groupBy("geneID").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("exons"))
    joined = block.join(own, "geneID")
    inside = F.aggregate("exons", F.lit(0).cast("bigint"), lambda a, x: a + overlap(F.col("b.s"), F.col("b.e"), x["s"], x["e"]))
    sums = joined.groupBy("sample", "geneID", "Read").agg(F.sum(F.col("b.e") - F.col("b.s")).alias("bp"), F.sum(inside).alias("exonic"))
    return sums.where((F.col("bp") > 0) & ((F.col("bp") - F.col("exonic")) / F.col("bp") > share))


def spliced_reads(reads: DataFrame, blocks: DataFrame, at_least: int) -> DataFrame:
    """Reads with enough introns; a read without blocks counts as none."""
    if at_least <= 0:
        return reads
    counts = blocks.select("geneID", "Read", F.size("introns").alias("_introns"))
    return reads.join(counts, ["geneID", "Read"], "left").where(F.coalesce("_introns", F.lit(0)) >= at_least).drop("_introns")


def prune_by_score(sites: DataFrame, by: list[str], score: str = "score", low: float = 0.1, share: float = 0.5) -> DataFrame:
    """Drop lowest scores until at most ``share`` of a group's sites score below ``low``.

    Closed form: dropping the j lowest of n leaves max(L - j, 0) / (n - j) low ones.
    """
    group = Window.partitionBy(*by)
    n, lows = F.count(F.lit(1)).over(group), F.count_if(F.col(score) < low).over(group)
    need = F.when(F.lit(share) >= 1, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil((F.col("_lows") - share * F.col("_n")) / (1 - share))))
    ranked = sites.withColumn("_n", n).withColumn("_lows", lows).withColumn("_rank", F.row_number().over(group.orderBy(score, "pos")))
    drop = F.least(need, F.col("_n"))
    return ranked.where(F.col("_rank") > drop).drop("_n", "_lows", "_rank")
