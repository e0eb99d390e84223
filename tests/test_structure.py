"""Exon detection, LSVs of exons and introns on hand-made genes, and against plain versions."""

import random

import pytest

from splicespark.operators import evidence as E
from splicespark.operators import structure as S


def exons_of(spark, exons, junctions):
    found = S.detected_exons(spark.createDataFrame(exons, "gene_id string, start int, end int"), spark.createDataFrame(junctions, "gene_id string, start int, end int"))
    out = {}
    for r in found.collect():
        out.setdefault(r.gene_id, []).append((r.start, r.end, r.annotated_start, r.annotated_end))
        assert r.annotated == (r.annotated_start != -1)
    return {g: sorted(x) for g, x in out.items()}


GENES = {
    # name: annotated exons, junctions, exons expected (start, end; -1 where a side is missing)
    "annotated": ([(100, 200), (500, 600)], [(200, 500)], [(100, 200), (500, 600)]),
    "widened": ([(100, 200), (1000, 1100)], [(-2, 100), (350, 700), (1100, -2)], [(100, 350), (700, 1100)]),
    "too far": ([(100, 200), (2000, 2100)], [(-2, 100), (700, 1500), (2100, -2)], [(100, 200), (2000, 2100), (-1, 700), (1500, -1)]),
    "de novo between": ([(100, 200), (5000, 5100)], [(200, 2000), (2150, 5000)], [(100, 200), (2000, 2150), (5000, 5100)]),
    "nested acceptors": ([(100, 200), (5000, 5100)], [(200, 2000), (200, 2050), (2150, 5000)], [(100, 200), (2000, 2150), (5000, 5100)]),
    "two donors": ([(100, 200), (5000, 5100)], [(200, 2000), (2150, 5000), (2300, 5000)], [(100, 200), (2000, 2300), (5000, 5100)]),
    "long span is two halves": ([(100, 200), (5000, 5100)], [(200, 2000), (2900, 5000)], [(100, 200), (2000, -1), (-1, 2900), (5000, 5100)]),
    "acceptor alone": ([(100, 200)], [(200, 2000)], [(100, 200), (2000, -1)]),
    "donor alone": ([(5000, 5100)], [(2000, 5000)], [(-1, 2000), (5000, 5100)]),
    "nothing annotated": ([], [(300, 2000)], [(-1, 300), (2000, -1)]),
    "sites without a partner in the exon": ([(100, 200), (1000, 1100)], [(350, 700)], [(-1, 350), (100, 200), (700, -1), (1000, 1100)]),
    "transcript ends don't count": ([(100, 200)], [(-2, 100), (200, -2)], [(100, 200)]),
    "no junctions": ([(100, 200)], [], [(100, 200)]),
}


@pytest.mark.parametrize("strand_turned", [False, True])
def test_hand_made_genes(spark, strand_turned):
    turn = (lambda a, b: tuple(10_000 - x if x > 0 else x for x in (b, a))) if strand_turned else (lambda a, b: (a, b))
    exons = [(g, *turn(*e)) for g, (known, _, _) in GENES.items() for e in known]
    junctions = [(g, *turn(*j)) for g, (_, found, _) in GENES.items() for j in found]
    got = exons_of(spark, exons, junctions)
    for g, (_, _, want) in GENES.items():
        assert [x[:2] for x in got[g]] == sorted(turn(*e) for e in want), g


def plain_sweep(exons, junctions):
    """The sweep of one gene, step by step on lists."""
    sites = sorted([(e, 0) for _, e in junctions if e > 0] + [(s, 1) for s, _ in junctions if s > 0])
    spans, stack, donor, island = [], [], None, None
    for at, is_donor in sites:
        if is_donor:
            left = stack.pop() if stack else island
            spans.append((at - 10 if left is None else left, at, left is not None, True))
            donor = at
            continue
        if not stack or donor is not None:
            spans += [(x, donor, True, True) for x in reversed(stack)]
            stack, donor, island = [], None, at
        stack.append(at)
    spans += [(x, x + 10 if donor is None else donor, True, donor is not None) for x in reversed(stack)]
    table = {e: [*e, *e] for e in exons}

    def half(start, end):
        key = (end - 10, end) if start == -1 else (start, start + 10) if end == -1 else (start, end)
        table.setdefault(key, [start, end, -1, -1])

    for start, end, opens, closes in spans:
        if end < start:
            continue
        met = next((k for k in sorted(table) if -1 not in table[k][:2] and start <= table[k][1] and end >= table[k][0]), None)
        if met is None and end - start <= 400:
            half(start if opens else -1, end if closes else -1)
        elif met is None:
            half(start, -1)
            half(-1, end)
        else:
            own, (low, high) = table[met], table[met][:2]
            own[0] = start if low - 400 <= start < low else low
            own[1] = end if high < end <= high + 400 else high
            if start < low - 400:
                half(start, -1)
            if end > high + 400:
                half(-1, end)
    return sorted(map(tuple, table.values()))


def test_random_genes(spark):
    rng = random.Random(3)
    genes = {}
    for k in range(150):
        span = rng.choice([800, 3000, 9000])
        starts = sorted(rng.sample(range(10, span, 5), rng.randint(0, 5)))
        known = [(s, min(s + rng.randint(5, 400), n - 1)) for s, n in zip(starts, [*starts[1:], span + 500]) if s + 1 < n - 1]
        junctions = {(a, b) for a, b in (sorted(rng.choices(range(5, span + 400, rng.choice([1, 50])), k=2)) for _ in range(rng.randint(0, 14))) if a < b}
        genes[f"g{k}"] = (known, sorted(junctions))
    got = exons_of(spark, [(g, *e) for g, x in genes.items() for e in x[0]], [(g, *j) for g, x in genes.items() for j in x[1]])
    for g, (known, junctions) in genes.items():
        assert got.get(g, []) == plain_sweep(known, junctions), (g, known, junctions)


def test_lsvs_of_exons(spark):
    exons = [(g, s, a, b) for g, s in (("p", "+"), ("m", "-")) for a, b in ((100, 200), (301, 400), (500, 600))]
    junctions = [(g, a, b) for g in "pm" for a, b in ((200, 301), (200, 500), (180, 500), (400, 500))]
    introns = [(g, 201, 300) for g in "pm"]
    found = S.exon_lsvs(spark.createDataFrame(exons, "gene_id string, strand string, start int, end int"), spark.createDataFrame(junctions, "gene_id string, start int, end int"), spark.createDataFrame(introns, "gene_id string, start int, end int")).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.lsv_id, r.junc_idx)):
        got.setdefault(r.lsv_id, []).append((r.start, r.end, r.is_intron))
        assert r.kind == r.lsv_id.split(":")[1]
    first, second, last = [(180, 500, False), (200, 301, False), (200, 500, False), (201, 300, True)], [(200, 301, False), (201, 300, True)], [(180, 500, False), (200, 500, False), (400, 500, False)]
    assert got == {
        "p:s:100-200": first, "p:t:301-400": second, "p:t:500-600": last,
        "m:t:100-200": [*first[2::-1], first[3]], "m:s:301-400": second, "m:s:500-600": last[::-1],
    }


EDGES = "gene_id string, src int, dst int, start int, end int, is_intron boolean, passed boolean, simplify boolean"


def test_what_counts_for_an_lsv(spark):
    e = [("g", 0, 1, 300, 1100, False, True, None), ("g", 0, 0, 150, 250, False, True, False), ("g", -1, 1, -2, 1100, False, True, False), ("g", 0, 2, 300, 2100, False, True, True)]
    one = S.usable_sides(spark.createDataFrame(e, EDGES)).collect()
    assert {(r.exon, r.side): (r.usable, r.passing) for r in one} == {(0, "s"): (1, 1), (1, "t"): (1, 1)}
    assert S.constitutive(spark.createDataFrame(e, EDGES)).count() == 1  # the others aren't usable
    more = [*e, ("g", 0, 3, 300, 3100, True, False, False)]
    assert {(r.exon, r.side) for r in S.lsv_sides(S.usable_sides(spark.createDataFrame(more, EDGES))).collect()} == {(0, "s")}


def test_simplified_by_kind_and_group(spark):
    groups = [("A", k) for k in range(4)] + [("B", k) for k in range(4, 6)]
    # by experiment the reads of: an annotated junction, a de-novo one, an intron; all leave exon 0
    reads = {0: (100, 5, 0), 1: (100, 5, 3), 2: (100, 1, 9), 3: (100, 0, 9), 4: (10, 9, 1), 5: (10, 1, 1)}
    kinds = [(1, 300, 1100, False, True), (2, 300, 2100, False, False), (3, 300, 3100, True, False)]
    rows = [(e, "g", 0, d, s, t, i, a, n) for e, x in reads.items() for (d, s, t, i, a), n in zip(kinds, x) if n]
    table = spark.createDataFrame(rows, "experiment int, gene_id string, src int, dst int, start int, end int, is_intron boolean, annotated boolean, reads long")
    sizes = spark.createDataFrame(groups, "grp string, experiment int")
    found = lambda **k: {r.end: r.simplify for r in S.simplified(table, sizes, **k).collect()}
    assert found(share=0.01, min_experiments=0.5) == {1100: False, 2100: False, 3100: False}
    assert found(share=0.01, min_denovo=6, min_experiments=0.5) == {1100: False, 2100: False, 3100: False}  # group B has one of two
    assert found(share=0.01, min_denovo=6, min_experiments=2) == {1100: False, 2100: True, 3100: False}
    assert found(share=0.01, min_intron=10, min_experiments=2) == {1100: False, 2100: False, 3100: True}
    assert found(share=0.01, min_annotated=101, min_experiments=1) == {1100: True, 2100: False, 3100: False}
    one_group = spark.createDataFrame([("all", e) for e in range(6)], "grp string, experiment int")
    assert {r.end: r.simplify for r in S.simplified(table, one_group, share=0.01, min_denovo=5, min_experiments=4).collect()} == {1100: False, 2100: True, 3100: False}


READS = "experiment int, read_id string, flag int, chrom string, pos int, cigar string, seq_len int"


def plain_offset(pos, cigar, start, end):
    """offset of a read to an intron, base by base, or None where the read is no evidence for it."""
    import re

    ops = [(int(n), c) for n, c in re.findall(r"(\d+)([MIDNSH])", cigar)]
    clip = ops[-1][0] if ops[-1][1] == "S" and len(ops) > 1 else 0
    body = [(n, c) for n, c in ops if c not in "SH"]
    bases, at, juncs, edges = [], pos + 1, [], [(pos, 0)]  # of each base of the read its place
    for n, c in body:
        if c == "N":
            juncs.append((at - 1, at + n))
        for _ in range(n):
            if c == "M":
                bases.append(at)
            if c == "I":
                bases.append(at - 1)
            at += c in "MDN"
        if c in "IDN":
            edges.append((at - 1, len(bases)))
    if len(bases) < 8 or any(a <= end and start <= b for a, b in juncs):
        return None
    if end < bases[7] or start > bases[len(bases) - 8]:
        return None
    if pos + 1 >= start:
        return len(bases) - 8 + pos + 1 - start + clip
    g, r = [e for e in edges if e[0] < start][-1]
    return len(bases) - 8 + g + 1 - start - r + clip


def test_intron_evidence_base_by_base(spark):
    rng = random.Random(7)
    reads = []
    for k in range(400):
        kind = k % 8
        a, b = rng.randint(4, 40), rng.randint(4, 40)
        cigar = [f"{a + b}M", f"{a}M{rng.randint(20, 200)}N{b}M", f"5S{a}M{b}M7S", f"{a}M3D{b}M", f"3H{a}M{b}M", f"{a}M2S", f"{a}M{rng.randint(1, 60)}N{b}M{rng.randint(1, 60)}N9M4S", f"{a + 9}M2I{b + 9}M"][kind]
        reads.append((k % 3, f"r{k}", [0, 16, 256, 4, 99, 147][rng.randrange(6)], "c", rng.randint(0, 600), cigar, a + b))
    introns = [("g", "c", "+", s, s + n) for s, n in ((50, 0), (60, 5), (100, 200), (305, 40), (400, 1), (500, -1), (520, 90))]
    spans = E.intron_spans(spark.createDataFrame(reads, READS))
    got = {(r.read_id, r.start): r.offset for r in E.intron_hits(spans, spark.createDataFrame(introns, "gene_id string, chrom string, strand string, start int, end int")).collect()}
    want = {}
    for _, name, flag, _, pos, cigar, _ in reads:
        for _, _, _, s, e in introns:
            if not flag & 0x104 and "I" not in cigar and (o := plain_offset(pos, cigar, s, e)) is not None:
                want[name, s] = o
    inserted = {r[1] for r in reads if "I" in r[5]}
    assert len(want) > 60 and {k: v for k, v in got.items() if k[0] not in inserted} == want
    assert any("N" not in r[5] for r in reads if any(k[0] == r[1] for k in got))


def test_introns_meet_the_splicegraph(spark):
    found = spark.createDataFrame([("g", 201, 900, 1, 5, 3), ("g", 950, 960, 1, 2, 1), ("g", 201, 300, 2, 7, 4), ("h", 1, 9, 1, 1, 1)], "gene_id string, start int, end int, experiment int, reads long, npos long")
    own = spark.createDataFrame([("g", 201, 499), ("g", 701, 949), ("g", 901, 900), ("g", 903, 902), ("g", 970, 990)], "gene_id string, start int, end int")
    got = {(r.start, r.experiment): (r.reads, r.npos) for r in E.matched_introns(found, own).collect()}
    assert got == {(201, 1): (5, 3), (701, 1): (2, 1), (901, 1): (5, 3), (201, 2): (7, 4)}
