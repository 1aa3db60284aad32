"""Small alignment and annotation files made for the tests.

Gene layout, read counts and flags are those for which duplication results are
known; positions are this file's own.
"""

from __future__ import annotations

import struct
import zlib

GENES = [  # id, chrom, strand, 1-based exons, reads, duplicates
    ("GENE_HIGH", "chr1", "+", [(1000, 1500), (2000, 2500), (3000, 3800)], 200, 40),
    ("GENE_MED", "chr1", "+", [(5000, 5600), (6000, 6500)], 50, 10),
    ("GENE_LOW", "chr1", "-", [(8000, 8500)], 10, 5),
    ("GENE_VLOW", "chr1", "-", [(10000, 10300)], 3, 2),
    ("GENE_ZERO", "chr1", "+", [(12000, 12400)], 0, 0),
    ("GENE_MED2", "chr2", "+", [(1000, 1400), (2000, 2600)], 80, 15),
    ("GENE_OVERLAP", "chr2", "-", [(4000, 4300), (4200, 4600), (4500, 4800)], 30, 5),
    ("GENE_SMALL", "chr2", "+", [(6000, 6100)], 100, 60),
]
HEADER = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:20000\n@SQ\tSN:chr2\tLN:20000\n"


def gtf_text() -> str:
    lines = ["#made for tests"]
    for gene, chrom, strand, exons, _, _ in GENES:
        for k, (s, e) in enumerate(exons, 1):
            lines.append(f'{chrom}\ttest\texon\t{s}\t{e}\t.\t{strand}\t.\tgene_id "{gene}"; gene_name "{gene}"; exon_number "{k}";')
    return "\n".join(lines) + "\n"


def records() -> list[dict]:
    out = []

    def add(name, chrom, pos, flag, nh):
        out.append({"qname": name, "flag": flag, "chrom": chrom, "pos": pos, "mapq": 0 if flag & 4 else 255, "cigar": "*" if flag & 4 else "50M", "seq": "A" * 50, "nh": nh})

    for gene, chrom, _, exons, reads, dups in GENES:
        s, e = exons[0]
        room = e - s - 49
        for k in range(reads):
            add(f"{gene}_{k}", chrom, s + (k * 7) % max(1, room), 1024 if k < dups else 0, 1)
        if gene == "GENE_MED2":
            for k in range(10):
                add(f"{gene}_multi_{k}", chrom, s + k, 0, 3)
    out.sort(key=lambda r: (r["chrom"], r["pos"]))
    for k in range(5):
        add(f"unmapped_{k}", "*", 0, 4, None)
    return out


def sam_text(rows: list[dict]) -> str:
    lines = []
    for r in rows:
        tag = f"\tNH:i:{r['nh']}" if r["nh"] else ""
        lines.append(f"{r['qname']}\t{r['flag']}\t{r['chrom']}\t{r['pos']}\t{r['mapq']}\t{r['cigar']}\t*\t0\t0\t{r['seq']}\t{'I' * len(r['seq'])}{tag}")
    return HEADER + "\n".join(lines) + "\n"


def bgzf(data: bytes, size: int) -> bytes:
    out = b""
    for start in range(0, len(data), size):
        part = data[start : start + size]
        pack = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = pack.compress(part) + pack.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bam_bytes(rows: list[dict], block: int = 700) -> bytes:
    refs = [("chr1", 20000), ("chr2", 20000)]
    data = b"BAM\x01" + struct.pack("<i", len(HEADER)) + HEADER.encode() + struct.pack("<i", len(refs))
    for name, length in refs:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    number = {n: k for k, (n, _) in enumerate(refs)}
    for r in rows:
        name = r["qname"].encode() + b"\0"
        ops = b"" if r["cigar"] == "*" else struct.pack("<I", 50 << 4)
        seq = bytes([0x11] * 25)
        tags = b"NHC" + bytes([r["nh"]]) if r["nh"] else b""
        body = struct.pack("<iiBBHHHiiii", number.get(r["chrom"], -1), r["pos"] - 1, len(name), r["mapq"], 0, len(ops) // 4, r["flag"], 50, -1, -1, 0) + name + ops + seq + bytes([40] * 50) + tags
        data += struct.pack("<i", len(body)) + body
    return bgzf(data, block)
