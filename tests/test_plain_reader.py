"""The reader that shares no code with the scan, comparisons of stores, and readers of other stores, on small inputs."""

import gzip
import hashlib
import itertools
import random
from urllib.parse import unquote

import pytest

from strandline.operators import envelope, fidelity, graph, transcripts
from strandline.sources import fasta, foreign, plain_reader

ROWS = [
    "##gff-version 3", "##sequence-region c1 1 1000", "##sequence-region c2 1 x", "# comment\twith\ttabs",
    "c1\tx\tregion\t1\t1000\t.\t+\t.\tID=r1;Is_circular=TRUE;genome=mitochondrion", "c2\tx\tregion\t1\t500\t.\t+\t.\tID=r2",
    "c1\tx\tgene\t900\t1100\t.\t+\t.\tID=g1;Note=a%2Cb,c,c;Note=d", "c1\tx\tmRNA\t950\t1100\t.\t+\t.\tID=t1;Parent=g1,g1", "c1\tx\tCDS\t950\t1000\t.\t+\t0\tID=c1;Parent=t1;k=1", "c1\tx\tCDS\t990\t1100\t.\t-\t0\tID=c1;Parent=gone;k=2",
    "c1\tx\texon\t1001\t1100\t.\t?\t.\tParent=t1,p1", "c1\tx\texon\t1001\t1100\t.\t?\t.\tParent=p1,t1;other=%zz%41%", "c2\tx\tpseudogene\t10\t5\t.\t.\t.\tID=p1; exception=Trans_Splicing ;novalue; =v;added=1",
    "c2\tx\tgene\tn\t5\t.\t.\t.\tID=bad", "c2\tx\tgene\t1\t5\t.\t.\tID=short", "", "   ", "c2\tx\tmatch\t 7 \t+9\t.\t.\t.\t.", "c2\tx\tmatch\t600\t700\t.\t.\t.\t", "c3\tx\tgene\t1\t2\t.\t+\t.\tID=g1", "c1\tx\texon\t5\t6\t.\t+\t.\tID=e;Parent=gone", "##FASTA later", "c2\tx\tgene\t1\t5\t.\t.\t.\tID=late",
]


def model(lines, ignore=()):
    """The same features, row by row over dictionaries."""
    feats, seqs, seen = {}, {}, {}
    for line in lines:
        if line.startswith("##FASTA"):
            break
        if line.startswith("##sequence-region"):
            p = line.split()
            if p[3].isdigit():
                seqs.setdefault(p[1], [None, False, ""])[0] = int(p[3])
            continue
        c = line.rstrip("\r").split("\t")
        if line.startswith("#") or not line.strip() or len(c) != 9:
            continue
        try:
            a, b = int(c[3]), int(c[4])
        except ValueError:
            continue
        at = {}
        for chunk in c[8].split(";") if c[8] not in ("", ".") else ():
            key, eq, value = chunk.strip().partition("=")
            if chunk.strip() and eq and unquote(key.strip()) not in ignore:
                at.setdefault(unquote(key.strip()), []).extend(unquote(v) for v in value.split(","))
        if c[2] == "region":
            s = seqs.setdefault(c[0], [None, False, ""])
            s[1] |= at.get("Is_circular", [""])[0].lower() == "true"
            s[2] = at.get("genome", [""])[0] or s[2]
        parents = ",".join(sorted(set(at.get("Parent", []))))
        rest = {k: v for k, v in at.items() if k not in ("ID", "Parent")}
        digest = hashlib.sha1("\x1e".join(f"{k}=" + "\x1f".join(sorted(set(v))) for k, v in sorted(rest.items())).encode()).hexdigest()
        key = at["ID"][0] if "ID" in at else None
        if key is None:
            base = "anon:" + hashlib.sha1("\t".join((c[0], c[2], str(a), str(b), c[6], parents)).encode()).hexdigest()[:24]
            seen[base] = seen.get(base, 0) + 1
            key = base if seen[base] == 1 else f"{base}#{seen[base]}"
        f = feats.setdefault(key, {"seqid": c[0], "type": c[2], "parents": parents, "rows": [], "strands": set(), "flags": {"no_id"} - ({"no_id"} if "ID" in at else set()), "conflicts": 0})
        f["conflicts"] += (f["seqid"], f["type"]) != (c[0], c[2])
        f["rows"].append((a, b, digest))
        f["strands"].add(c[6])
        f["flags"] |= {n for n, on in (("inverted", a > b), ("strand_unknown", c[6] == "?"), ("multi_valued", any(len(v) > 1 for v in rest.values())), ("trans_spliced", any(w in " ".join(at.get("exception", [])).lower() for w in ("trans-splicing", "trans_splicing")))) if on}
    for f in feats.values():
        f["lo"], f["hi"] = min(min(r[:2]) for r in f["rows"]), max(max(r[:2]) for r in f["rows"])
    out = set()
    for key, f in feats.items():
        length, circular, genome = seqs.get(f["seqid"], (None, False, ""))
        flags, spans = f["flags"], sorted(tuple(sorted(r[:2])) for r in f["rows"])
        flags |= {n for n, on in (("multi_row", len(spans) > 1), ("overlapping_rows", any(y[0] <= x[1] for x, y in zip(spans, spans[1:]))), ("organelle", genome in plain_reader.ORGANELLES), ("rows_disagree", len({r[2] for r in f["rows"]}) > 1)) if on}
        if length is not None and f["hi"] > length:
            flags.add("crosses_origin" if circular and f["lo"] <= length else "past_end")
        for name in f["parents"].split(",") if f["parents"] else ():
            p = feats.get(name)
            flags |= {n for n, on in (("dangling_parent", p is None), ("escapes_parent", p and (f["lo"] < p["lo"] or f["hi"] > p["hi"])), ("exon_under_pseudogene", p and f["type"] == "exon" and p["type"] == "pseudogene"), ("multi_parent", "," in f["parents"])) if on}
        lines_ = sorted(f"{a}\t{b}\t{d}" for a, b, d in f["rows"])
        attrs = f["rows"][0][2] if "rows_disagree" not in flags else "rows:" + hashlib.sha1("\n".join(lines_).encode()).hexdigest()
        out.add((key, f["seqid"], f["type"], ",".join(sorted(f["strands"])), f["lo"], f["hi"], len(spans), ",".join(f"{a}-{b}" for a, b, _ in sorted(f["rows"])), f["parents"], attrs, 1, ",".join(sorted(flags)), f["conflicts"]))
    return out


@pytest.mark.parametrize("name, end", [("a.gff3", "\n"), ("b.gff3", "\r\n"), ("c.gff3.gz", "\n")])
def test_features_of_a_text(spark, tmp_path, name, end):
    data = end.join(ROWS).encode()
    (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    text = plain_reader.read(spark, f"file://{tmp_path}/{name}", ignore=["added"])
    got = {tuple(r) for r in plain_reader.features(text).collect()}
    assert got == model(ROWS, {"added"})
    assert {f for r in got for f in r[11].split(",")} >= set(plain_reader.HARD_CASES) and sum(r[12] for r in got) == 1
    facts = {(r.kind, r.name): r.n for r in plain_reader.summary(text, plain_reader.features(text)).collect()}
    assert facts["total", "rows"] == 14 and facts["total", "non_numeric_rows"] == 1 and facts["total", "circular_sequences"] == 1 and facts["hard case", "past_end"] == 2 and facts["type with parent", "exon"] == 3


def test_an_empty_text(spark, tmp_path):
    (tmp_path / "e.gff3").write_text("##gff-version 3\n")
    text = plain_reader.read(spark, f"file://{tmp_path}/e.gff3")
    assert plain_reader.features(text).count() == 0
    assert {r.n for r in plain_reader.summary(text, plain_reader.features(text)).collect()} == {0}


def test_keys_and_types_in_messages(spark):
    r = random.Random(3)
    keys = ["".join(r.choice("ab-1.") for _ in range(r.randint(1, 6))) for _ in range(150)] + ["a b", "x=1", "", "no such key", "b\\E"]
    lines = [" ".join("".join(r.choice("ab-1.;") for _ in range(r.randint(0, 9))) for _ in range(4)) for _ in range(12)] + ["has a b in it", "x=1;"]
    log = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {x.key for x in fidelity.named_keys(spark.createDataFrame([(k,) for k in keys], "key string"), log).collect()}
    assert got == {k for k in keys if k and k in "\n".join(lines)}
    types = spark.createDataFrame([(t,) for t in ("D-loop", "gene", "exon", "five_prime_UTR", "a.c")], "type string")
    log = spark.createDataFrame([("Skipped 3 D-loop rows",), ("unknown exon_part, abc",), ("gene rows are read",), ("five_prime_UTR: discarded",)], "line string")
    assert {x.type for x in fidelity.announced_types(types, log).collect()} == {"D-loop", "five_prime_UTR"}
    assert fidelity.named_keys(types.withColumnRenamed("type", "key").limit(0), log).count() == 0


def test_pairs_in_stages(spark):
    """A partner that must be the only one, and partners in order, against a model with lists."""
    r = random.Random(4)
    side = lambda mark: [(f"{mark}{i:03d}", r.choice(["n1", "n2", "n3", None]), "s", r.randint(1, 3), r.randint(4, 5), r.choice("+-"), r.choice(["mRNA", "tRNA", None])) for i in range(40)]
    columns = ["id", "name", "seqid", "start", "end", "strand", "type"]
    left, right = side("l"), side("r")
    ddl = "id string, name string, seqid string, start long, end long, strand string, type string"
    got = {tuple(x) for x in transcripts.pair(spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl), cut=graph._cut).collect()}
    want = set()
    free, others = [dict(zip(columns, x)) for x in left], [dict(zip(columns, x)) for x in right]
    for stage, by, unique in transcripts.STAGES:
        groups = [{}, {}]
        for k, rows in enumerate((free, others)):
            for x in rows:
                if None not in (sign := tuple(x[c] for c in by)):
                    groups[k].setdefault(sign, []).append(x["id"])
        found = {p for s, a in groups[0].items() for b in [groups[1].get(s, [])] if not unique or len(a) == len(b) == 1 for p in zip(a, b)}
        want |= {(*p, stage) for p in found}
        free, others = [x for x in free if x["id"] not in {p[0] for p in found}], [x for x in others if x["id"] not in {p[1] for p in found}]
    assert got == want and len({x[2] for x in got}) >= 2


def test_names_of_gene_models(spark):
    kinds = transcripts.Kinds(["gene"], ["mRNA"], ["exon"], ["CDS"])

    def named(rows):
        df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "at long, type string, id string, name string, transcript_id string, gene_id string")
        return [{x.id: x.name for x in side.collect()} for side in transcripts.names(df, kinds)]

    plain = [("gene", "gene:1", None, None, None), ("gene", "gene:2", None, None, None), ("mRNA", "mRNA-1", "N", None, None), ("mRNA", "mRNA-2", None, None, None), ("other", "o", "x", "T", "G")]
    assert named(plain) == [{"gene:1": "1", "gene:2": "2", "mRNA-1": "N", "mRNA-2": None}, {"gene:1": "1", "gene:2": "2"}]
    bare = [("gene", "gene-1", "same", None, None), ("gene", "gene-2", "same", None, None), ("mRNA", "mRNA:1", None, None, None)]
    assert named(bare) == [{"gene-1": "same", "gene-2": "same", "mRNA:1": "1"}, {"gene-1": "1", "gene-2": "2"}]  # one name for two genes is no name
    ids = [("gene", "g1", "a", None, "G1"), ("gene", "g2", "b", None, "G2"), ("mRNA", "t1", "n", "T1", None), ("exon", "e", None, None, None)]
    assert named(ids) == [{"g1": None, "g2": None, "t1": "T1"}, {"g1": "G1", "g2": "G2"}]


def test_a_store_of_gene_models(spark, tmp_path):
    for name, text in {
        "transcripts.tsv": "tx_id\ttx_name\ttype\tseqid\tstrand\tstart\tend\tgenes\n1\tT1\tmRNA\tc\t*\t1\t90\tG1,G2\n2\t\tmRNA\tc\t+\t5\t6\t\n", "exons.tsv": "tx_id\tstart\tend\n1\t50\t90\n1\t1\t20\n", "cds.tsv": "tx_id\tstart\tend\n",
        "genes.tsv": "gene_id\nG1\n", "types.txt": "gene\tpackage\tgene\ntranscript\tpackage\tmRNA\n",
    }.items():
        (tmp_path / name).write_text(text)
    tx, exons, cds, genes, types = foreign.gene_models(spark, f"file://{tmp_path}")
    have = {r.id: r for r in transcripts.held(tx, exons, cds).collect()}
    assert (have["1"].strand, have["1"].genes, [tuple(x) for x in have["1"].exons], have["1"].cds) == (".", ["G1", "G2"], [(1, 20), (50, 90)], [])
    assert have["2"].name is None and have["2"].genes == [] and genes.count() == 1 and types.count() == 2


OBO = """format-version: 1.2
[Term]
id: X:1
name: root

[Term]
id: X:2
name: two
synonym: "a \\"b\\" c" EXACT [x]
synonym: "a \\"b\\" c" BROAD []
is_a: X:1 ! root
relationship: part_of X:3 ! three
[Term]
id: X:3
name: three
is_a: X:2 {source="y"} ! a ring
is_obsolete: true
[Instance]
id: i
name: i
[Term]
id: X:4
"""


def test_an_ontology(spark, tmp_path):
    (tmp_path / "o.obo").write_text(OBO)
    terms, edges, synonyms = foreign.ontology(spark, f"file://{tmp_path}/o.obo")
    assert {tuple(r) for r in terms.collect()} == {("X:1", "root", "Term", False), ("X:2", "two", "Term", False), ("X:3", "three", "Term", True)}
    assert {tuple(r) for r in edges.collect()} == {("X:2", "is_a", "X:1"), ("X:2", "part_of", "X:3"), ("X:3", "is_a", "X:2")}
    assert [(r.id, r.text.replace("\\", "")) for r in synonyms.collect()] == [("X:2", 'a "b" c')]
    assert {tuple(r) for r in foreign.ancestors(edges).collect()} == {("X:2", "X:1", 1), ("X:2", "X:3", 1), ("X:3", "X:2", 1), ("X:3", "X:1", 2)}  # a ring ends
    assert {tuple(r)[:2] for r in foreign.ancestors(edges, ("is_a",)).collect()} == {("X:2", "X:1"), ("X:3", "X:2"), ("X:3", "X:1")}


def test_bases_by_the_index(spark, tmp_path):
    bases = {"a": "ACGTTGCAAC" * 7 + "GG", "b": "T", "c": "", "d": "ACGTACGTAC" * 3}
    text = "".join(f">{n} more\n" + "".join(s[i : i + 10] + "\n" for i in range(0, len(s), 10)) for n, s in bases.items()) + ">e\nACG\nAC\nACG\n>f\r\nACGT\r\nAC\r\n"
    (tmp_path / "s.fa").write_text(text, newline="")
    path = f"file://{tmp_path}/s.fa"
    found = fasta.index(spark, path)
    rows = {r.seqid: r for r in found.collect()}
    for n, s in bases.items():
        assert rows[n].length == len(s) and rows[n].even
        if s:
            at = fasta.place(rows[n].offset, rows[n].line_bases, rows[n].line_width, len(s) - 1)
            assert text[at] == s[-1]
    assert not rows["e"].even and (rows["f"].line_bases, rows["f"].line_width, rows["f"].length) == (4, 6, 6)
    assert fasta.fetch(spark, path, found, "a", 8, 33) == bases["a"][7:33] and fasta.fetch(spark, path, found, "f", 3, 6) == "GTAC"
    with pytest.raises(ValueError):
        fasta.fetch(spark, path, found, "e", 1, 2)
    assert fasta.index_lines(found).orderBy("ordinal").first().value == "a\t72\t8\t10\t11"


def test_repair_by_levels(spark):
    """Random forests with inverted rows and features of several segments, against a model that goes up from the leaves."""
    r = random.Random(5)
    rows, kids = {}, {}
    for i in range(200):
        parent = f"n{r.randrange(i)}" if i and r.random() < 0.8 else "gone" if r.random() < 0.1 else None
        a, b = r.randint(1, 500), r.randint(1, 500)
        rows[f"n{i}"] = (parent, a, b, r.choice((1, 1, 1, 2)))
        kids.setdefault(parent, []).append(f"n{i}")
    want = {}

    def fix(n):
        _, a, b, segments = rows[n]
        spans = [fix(k) for k in kids.get(n, [])]
        if spans and segments == 1:
            lo, hi = min(x for x, _ in spans), max(y for _, y in spans)
            a, b = (lo, hi) if a > b else (min(a, lo), max(b, hi))
        want[n] = a, b
        return a, b

    for n in itertools.chain(kids.get(None, []), kids.get("gone", [])):
        fix(n)
    df = spark.createDataFrame([(n, *x) for n, x in rows.items()] + [("x", "y", 5, 6, 1), ("y", "x", 1, 2, 1)], "id string, parent_id string, start long, end long, n_segments long")
    got = {x.id: (x.start, x.end) for x in envelope.repair(df).collect()}
    assert got == want | {"x": (5, 6), "y": (1, 2)}  # a ring stays as it is
