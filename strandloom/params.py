"""Mapping and indexing parameters, presets, and the small option languages."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: Coefficients of the estimated fraction of reads in peaks.
FRIP_COEFFICIENTS = (-1.0996, 4.2391, 3.0164e-05, -2.1087e-04, -5.5825e-05)
FORMATS = ("BED", "TagAlign", "SAM", "pairs", "PAF")


@dataclass(frozen=True)
class IndexParams:
    """k-mer and window size of the minimizer index."""

    kmer_size: int = 17
    window_size: int = 7

    def __post_init__(self) -> None:
        if not (1 <= self.kmer_size <= 28 and 1 <= self.window_size <= 255):
            raise ValueError("k must be within 1..28 and w within 1..255")

    @classmethod
    def for_fragments(cls, least_length: int) -> IndexParams:
        """Sizes that suit the shortest fragment expected."""
        for longest, k, w in ((60, 17, 7), (80, 19, 10)):
            if least_length <= longest:
                return cls(k, w)
        return cls(23, 11)


@dataclass(frozen=True)
class MapParams:
    """Parameters of mapping and post-processing; defaults suit single reads without a preset."""

    error_threshold: int = 8
    min_seeds: int = 2
    max_seed_frequencies: tuple[int, int] = (500, 1000)
    max_insert_size: int = 1000
    mapq_threshold: int = 30
    min_read_length: int = 30
    max_best_mappings: int = 1
    drop_repetitive_reads: int = 500_000
    match: int = 1
    mismatch: int = 4
    #: of deletions from the read, and of insertions into it
    gap_open: tuple[int, int] = (6, 6)
    gap_extend: tuple[int, int] = (1, 1)
    trim_adapters: bool = False
    remove_duplicates: bool = False
    duplicates_at_bulk_level: bool = True
    tn5_shift: bool = False
    split_alignment: bool = False
    low_memory: bool = False
    barcode_errors: int = 1
    barcode_probability: float = 0.9
    keep_unlisted_barcodes: bool = False
    skip_barcode_check: bool = False
    allocate_multi_mappings: bool = False
    allocation_distance: int = 0
    seed: int = 11
    cache_size: int = 4_000_003
    minhash_size: int = 250
    frip_coefficients: tuple[float, ...] = FRIP_COEFFICIENTS
    count_cache_slots: bool = True
    output_format: str = "BED"
    read_format: str = ""

    def __post_init__(self) -> None:
        if not 0 <= self.error_threshold < 16:
            raise ValueError("error_threshold must be within 0..15")
        if self.output_format not in FORMATS:
            raise ValueError(f"output_format must be one of {FORMATS}")
        if not 1 <= self.minhash_size < 2000:
            raise ValueError("minhash_size must be within 1..1999")
        if not 1 <= self.max_best_mappings <= self.drop_repetitive_reads:
            raise ValueError("max_best_mappings must be within 1..drop_repetitive_reads")
        if len(self.frip_coefficients) != 5:
            raise ValueError("five coefficients are needed")
        if self.max_seed_frequencies[0] > self.max_seed_frequencies[1]:
            raise ValueError("the second seed frequency must not be below the first")

    def but(self, **changes) -> MapParams:
        """A copy with some values changed."""
        return replace(self, **changes)


def preset(name: str) -> MapParams:
    """Parameters of an assay: ``atac``, ``chip`` or ``hic``."""
    known = {
        "atac": MapParams(max_insert_size=2000, trim_adapters=True, remove_duplicates=True, duplicates_at_bulk_level=False, tn5_shift=True, low_memory=True),
        "chip": MapParams(max_insert_size=2000, remove_duplicates=True, low_memory=True),
        "hic": MapParams(error_threshold=4, mapq_threshold=1, split_alignment=True, low_memory=True, output_format="pairs"),
    }
    if name not in known:
        raise ValueError(f"unknown preset {name!r}; there are {sorted(known)}")
    return known[name]


def parse_frip(text: str) -> tuple[float, ...]:
    """Five coefficients separated by semicolons or commas."""
    numbers = tuple(float(x) for x in text.replace(";", ",").split(","))
    if len(numbers) != 5:
        raise ValueError("five coefficients are needed")
    return numbers


@dataclass(frozen=True)
class EffectiveRange:
    """Inclusive base ranges of one input (-1 is its last base) and whether to reverse-complement."""

    ranges: tuple[tuple[int, int], ...] = ((0, -1),)
    strand: str = "+"


@dataclass
class ReadFormat:
    """Effective ranges of the inputs named r1, r2 and bc."""

    inputs: dict[str, EffectiveRange] = field(default_factory=dict)

    def of(self, name: str) -> EffectiveRange:
        return self.inputs.get(name, EffectiveRange())


def parse_read_format(text: str) -> ReadFormat:
    """``name:start:end[:strand]``, comma-separated; a name may repeat, its ranges then follow on."""
    ranges: dict[str, list[tuple[int, int]]] = {}
    strands: dict[str, str] = {}
    for part in filter(None, (x.strip() for x in text.split(","))):
        name, *rest = part.split(":")
        if name not in ("r1", "r2", "bc") or len(rest) not in (2, 3) or (len(rest) == 3 and rest[2] not in "+-"):
            raise ValueError(f"unknown read format {part!r}")
        start, end = int(rest[0]), int(rest[1])
        if start < 0 or (end != -1 and end < start):
            raise ValueError(f"empty range in {part!r}")
        ranges.setdefault(name, []).append((start, end))
        strands[name] = rest[2] if len(rest) == 3 else strands.get(name, "+")
    return ReadFormat({n: EffectiveRange(tuple(r), strands[n]) for n, r in ranges.items()})
