"""A small set with known outcome: three genes on one chromosome, three samples in each of two groups."""

JUNCTIONS = {  # name: start, end, reads a sample in group 1 and group 2
    "A1": (1100, 2000, 20, 7), "A2": (2100, 3000, 20, 7), "A3": (1100, 3000, 10, 36),
    "B1": (5100, 5950, 20, 20), "B2": (5100, 6000, 20, 20),
    "C1": (8100, 8500, 20, 10), "C2": (8600, 9000, 20, 10), "C3": (9100, 9500, 10, 20), "C4": (9600, 10000, 10, 20), "C5": (8100, 9000, 10, 10),
}
LABELS = {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
TRANSCRIPTS = {
    ("GENE_A", "A.t1"): [(1000, 1100), (2000, 2100), (3000, 3100)],
    ("GENE_A", "A.t2"): [(1000, 1100), (3000, 3100)],
    ("GENE_B", "B.t1"): [(5000, 5100), (5950, 6100)],
    ("GENE_B", "B.t2"): [(5000, 5100), (6000, 6100)],
    ("GENE_C", "C.t1"): [(8000, 8100), (8500, 8600), (9000, 9100), (9500, 9600), (10000, 10100)],
}


def reads():
    rows = []
    for s, label in LABELS.items():
        for name, (start, end, a, b) in JUNCTIONS.items():
            rows += [(s, f"{name}.{s}.{k}", 0, "chr1", start - 25, 60, f"25M{end - start}N25M", 1, 100) for k in range(b if label else a)]
        for at in (8075, 8575):
            rows += [(s, f"two.{at}.{s}.{k}", 0, "chr1", at, 60, "25M400N2M400N23M", 1, 100) for k in range(3)]
    return rows


def genome():
    seq = bytearray(b"ACGT" * 2750)
    for at in (1100, 2100, 5100, 8100, 8600, 9100, 9600):
        seq[at : at + 2] = b"GT"
    for at in (1998, 2998, 5948, 5998, 8498, 8998, 9498, 9998):
        seq[at : at + 2] = b"AG"
    return seq.decode()


def gtf():
    lines = ["# a comment"]
    genes = {}
    for (g, _), exons in TRANSCRIPTS.items():
        lo, hi = genes.get(g, (10**9, 0))
        genes[g] = min(lo, exons[0][0]), max(hi, exons[-1][1])
    for g, (lo, hi) in genes.items():
        lines.append(f'chr1\tx\tgene\t{lo + 1}\t{hi}\t.\t+\t.\tgene_id "{g}"; gene_name "N {g}"; gene_type "protein_coding";')
    for (g, t), exons in TRANSCRIPTS.items():
        lines += [f'chr1\tx\texon\t{lo + 1}\t{hi}\t.\t+\t.\tgene_id "{g}"; transcript_id "{t}"; gene_name "N {g}"; gene_type "protein_coding";' for lo, hi in exons]
    lines.append('chr1\tx\tgene\t1\t500\t.\t+\t.\tgene_id "LNC"; gene_type "lncRNA";')
    lines.append('chr1\tx\tgene\t600\t700\t.\t+\t.\tgene_id "NOTYPE";')
    return "\n".join(lines) + "\n"


def sam(sample):
    head = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:11000\n"
    return head + "".join(f"{q}\t{flag}\t{c}\t{pos + 1}\t{mq}\t{cigar}\t*\t0\t0\t*\t*\tNH:i:{nh}\tAS:i:{score}\n" for s, q, flag, c, pos, mq, cigar, nh, score in reads() if s == sample)


def bam(rows):
    """Bytes of a BAM file of two reference names, in two compressed members."""
    import gzip
    import re
    import struct

    names = ["chr1", "chr2"]
    out = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(names)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 11000) for n in names)
    body = b""
    for _, q, flag, chrom, pos, mapq, cigar, nh, score in rows:
        ops = [(int(n), "MIDNSHP=X".index(o)) for n, o in re.findall(r"(\d+)(\D)", cigar)] if cigar != "*" else []
        name = q.encode() + b"\0"
        tags = (b"NHC" + bytes([nh]) if nh is not None else b"") + (b"ASi" + struct.pack("<i", score) if score is not None else b"") + b"XZZabc\0" + b"XBBs" + struct.pack("<Ihh", 2, 1, 2)
        rec = struct.pack("<iiIIiiii", names.index(chrom) if chrom else -1, pos, len(name) | mapq << 8, len(ops) | flag << 16, 3, -1, -1, 0) + name + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + b"\x11\x10" + b"\xff" * 3 + tags
        body += struct.pack("<i", len(rec)) + rec
    half = len(body) // 2
    return gzip.compress(out + body[:half]) + gzip.compress(body[half:]) + gzip.compress(b"")
