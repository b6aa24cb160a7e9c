"""Parameters by assay, the rules that they obey, and small parsers."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Parameters:
    errors: int = 8
    min_seeds: int = 2
    max_seed_frequencies: tuple[int, int] = (500, 1000)
    max_insert: int = 1000
    min_read_length: int = 30
    best: int = 1
    drop_repetitive: int = 500_000
    trim_adapters: bool = False
    remove_duplicates: bool = False
    bulk_level_dedup: bool = True
    tn5_shift: bool = False
    tn5: tuple[int, int] = (4, -5)
    shift_after_dedup: bool = True
    split_alignment: bool = False
    least_mapq: int = 30
    barcode_errors: int = 1
    barcode_confidence: float = 0.9
    output: str = "bed"
    output_off_whitelist: bool = False
    allocate_multi: bool = False
    p_value: float | None = 1e-5
    q_value: float | None = None


PRESETS = {
    "atac": Parameters(trim_adapters=True, remove_duplicates=True, tn5_shift=True, bulk_level_dedup=False, max_insert=2000),
    "chip": Parameters(remove_duplicates=True, max_insert=2000),
    "hic": Parameters(errors=4, least_mapq=1, split_alignment=True, output="pairs"),
}


def preset(name: str, **changes) -> Parameters:
    p = replace(PRESETS[name], **changes)
    check(p)
    return p


def check(p: Parameters) -> None:
    """Raises for values that can't be used together."""
    rules = {
        "errors must be 1 to 15": 0 < p.errors <= 15,
        "barcode errors must be 0 to 2": 0 <= p.barcode_errors <= 2,
        "confidence must be 0 to 1": 0 <= p.barcode_confidence <= 1,
        "output must be bed, tagalign, paf, sam, bam or pairs": p.output in ("bed", "tagalign", "paf", "sam", "bam", "pairs"),
        "split alignments are written as pairs or sam": not p.split_alignment or p.output in ("pairs", "sam", "bam"),
        "give a p-value or a q-value": (p.p_value is None) != (p.q_value is None),
        "the higher seed frequency comes second": p.max_seed_frequencies[0] <= p.max_seed_frequencies[1],
        "insert and read lengths must be positive": p.max_insert > 0 and p.min_read_length > 0,
    }
    broken = [text for text, ok in rules.items() if not ok]
    if broken:
        raise ValueError("; ".join(broken))


def size(text: str) -> int:
    """`8G`, `512M`, `4k` or a plain number, in bytes."""
    units = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}
    text = text.strip().upper().removesuffix("B")
    return int(float(text[:-1]) * units[text[-1]]) if text[-1:] in units else int(text)


def y_paths(path: str, default: str = "y_separated/") -> tuple[str, str]:
    """Where the Y and the other reads of a file go: `_Y` and `_noY` before the last `_R<n>`, else before the extension."""
    import re

    folder, _, name = path.rpartition("/")
    stem, ext = re.fullmatch(r"(.*?)((?:\.(?:fastq|fq|fasta|fa|bam|sam|cram))?(?:\.gz)?)", name).groups()
    at = [m.start() for m in re.finditer(r"_R\d", stem)]
    cut = at[-1] if at else len(stem)
    base = f"{folder}/{default}" if folder else default
    return tuple(f"{base}{stem[:cut]}{tag}{stem[cut:]}{ext}" for tag in ("_Y", "_noY"))
