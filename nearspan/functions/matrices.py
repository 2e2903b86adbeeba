"""Substitution matrices: built from rules, counts or NCBI text, and alignments scored by them."""

from __future__ import annotations

import io
from dataclasses import dataclass, replace
from pathlib import Path

import numpy as np

from nearspan.functions import batch
from nearspan.functions.paths import align

#: The value as a Spark struct.
MATRIX_SCHEMA = "struct<name: string, alphabet: string, scores: binary, wildcard: string, gap_score: bigint, gap_open: bigint, gap_extend: bigint>"
ASCII = "".join(map(chr, range(128)))


@dataclass(frozen=True)
class Matrix:
    """scores[i, j]: a query's i-th symbol against a target's j-th. Symbols outside the alphabet count as the wildcard; case matters."""

    name: str
    alphabet: str
    scores: np.ndarray
    wildcard: str = "X"
    gap_score: int = -4
    gap_open: int | None = None
    gap_extend: int | None = None

    def __post_init__(self):
        n = len(self.alphabet)
        if not 1 <= n <= 256 or len(set(self.alphabet)) != n:
            raise ValueError("an alphabet has 1 to 256 different symbols")
        grid = np.asarray(self.scores)
        if grid.shape != (n, n):
            raise ValueError(f"{n} symbols need {n} x {n} scores, not {grid.shape}")
        if not np.array_equal(grid, np.asarray(grid, np.int64)) or np.abs(np.asarray(grid, np.int64) + 0.5).max() > 127.5:
            raise ValueError("scores must be whole numbers from -128 to 127")
        if len(self.wildcard) != 1 or self.wildcard not in self.alphabet:
            raise ValueError("the wildcard must be a symbol of the alphabet")
        if (self.gap_open is None) != (self.gap_extend is None):
            raise ValueError("gap_open and gap_extend go together")
        object.__setattr__(self, "scores", np.ascontiguousarray(grid, np.int8))

    @property
    def wildcard_index(self) -> int:
        return self.alphabet.index(self.wildcard)

    def encode(self, s: str) -> list[int]:
        at = {c: i for i, c in enumerate(self.alphabet)}
        return [at.get(c, self.wildcard_index) for c in s]

    def info(self) -> dict:
        return {
            "name": self.name, "alphabet": self.alphabet, "stride": len(self.alphabet), "wildcard_index": self.wildcard_index, "gap_score": self.gap_score,
            "gap_open": self.gap_open, "gap_extend": self.gap_extend,
        }

    def transpose(self, name: str | None = None) -> "Matrix":
        return replace(self, name=name or f"{self.name}.T", scores=self.scores.T)

    def step_limit(self, gap_open: int | None = None, gap_extend: int | None = None) -> int:
        """Largest size of one step's score: of a cell, or of the gaps given, else the matrix's own."""
        gaps = [g for g in (gap_open, gap_extend) if g is not None] or [g for g in (self.gap_score, self.gap_open, self.gap_extend) if g is not None]
        return max(int(np.abs(self.scores.astype(int)).max()), *map(abs, gaps))

    def row(self) -> dict:
        return {"name": self.name, "alphabet": self.alphabet, "scores": self.scores.tobytes(), "wildcard": self.wildcard, "gap_score": self.gap_score, "gap_open": self.gap_open, "gap_extend": self.gap_extend}

    @classmethod
    def of(cls, row) -> "Matrix":
        """From a Spark struct."""
        row = row if isinstance(row, dict) else row.asDict()
        n = len(row["alphabet"])
        return cls(row["name"], row["alphabet"], np.frombuffer(bytes(row["scores"]), np.int8).reshape(n, n), row["wildcard"], row["gap_score"], row["gap_open"], row["gap_extend"])

    def _coded(self, strings: list[str]) -> list[str]:
        wild = self.wildcard_index

        class Codes(dict):
            def __missing__(self, _):
                return wild

        codes = Codes({ord(c): i for i, c in enumerate(self.alphabet)})
        return [s.translate(codes) for s in strings]

    def scores_of(self, queries: list[str], targets: list[str], local: bool, gap_open: int = -1, gap_extend: int | None = None) -> np.ndarray:
        """Smith-Waterman (local) or Needleman-Wunsch scores. The matrix's own gaps are not used unless they are passed."""
        grid = self.scores.astype(np.int64)
        look_up = lambda x, y: grid[np.maximum(x, 0), np.maximum(y, 0)]  # noqa: E731  the padding is never read out
        return batch.alignment(self._coded(queries), self._coded(targets), local, look_up, gap_open=gap_open, gap_extend=gap_extend)

    def path(self, query: str, target: str, local: bool, gap_open: int = -1, gap_extend: int | None = None) -> dict:
        at = {c: i for i, c in enumerate(self.alphabet)}
        wild, grid = self.wildcard_index, self.scores.tolist()
        return align(
            query, target, local, gap_open=gap_open, gap_extend=gap_extend, score=lambda p, q: grid[at.get(p, wild)][at.get(q, wild)],
            same=lambda p, q: at.get(p, wild) == at.get(q, wild),
        )

    def score(self, query: str, target: str) -> int:
        """Local score with the matrix's own linear gap."""
        return int(self.scores_of([query], [target], True, self.gap_score)[0])


def identity(alphabet: str, match: int = 1, mismatch: int = 0, wildcard: str = "*", name: str = "IDENTITY", gap_score: int = -1, gap_open: int | None = None, gap_extend: int | None = None) -> Matrix:
    """match on the diagonal, mismatch elsewhere; the wildcard, added where missing, matches nothing, itself included."""
    alphabet = alphabet if wildcard in alphabet else alphabet + wildcard
    grid = np.full((len(alphabet), len(alphabet)), mismatch)
    np.fill_diagonal(grid, match)
    w = alphabet.index(wildcard)
    grid[w, w] = mismatch
    return Matrix(name, alphabet, grid, wildcard, gap_score, gap_open, gap_extend)


def ascii_text(match: int = 1, mismatch: int = -1, name: str = "ASCII", gap_score: int = -1, gap_open: int | None = None, gap_extend: int | None = None) -> Matrix:
    """All 128 ASCII characters; DEL stands for every other."""
    return identity(ASCII, match, mismatch, chr(127), name, gap_score, gap_open, gap_extend)


def dna(match: int = 5, mismatch: int = -4) -> Matrix:
    return identity("ACGT", match, mismatch, "N", "DNA_MATCH", mismatch)


#: The bases that each IUPAC nucleotide code stands for.
IUPAC = {"A": "A", "T": "T", "G": "G", "C": "C", "S": "GC", "W": "AT", "R": "AG", "Y": "CT", "K": "GT", "M": "AC", "B": "CGT", "V": "ACG", "H": "ACT", "D": "AGT", "N": "ACGT"}


def nucleotides() -> Matrix:
    """NUC.4.4 by its rule: 9 p - 4, rounded away from zero, p being the chance that two codes mean the same base.

    A code of several bases against itself, and N against any of several bases, is -1.
    """

    def cell(a: str, b: str) -> int:
        x, y = IUPAC[a], IUPAC[b]
        if len(x) > 1 and len(y) > 1 and (a == b or "N" in (a, b)):
            return -1
        s = 9 * len(set(x) & set(y)) / (len(x) * len(y)) - 4
        return int(np.sign(s) * np.floor(abs(s) + 0.5))

    return Matrix("NUC.4.4", "".join(IUPAC), [[cell(a, b) for b in IUPAC] for a in IUPAC], "N", *default_gaps("NUC.4.4"))


def default_gaps(name: str) -> tuple[int, int, int]:
    """(gap_score, gap_open, gap_extend) of a standard matrix by family and level; fixed values."""
    family = name.rstrip("0123456789")
    level = int(name[len(family) :] or 0)
    ladders = {
        "BLOSUM": ((80, (-5, -10, -1)), (62, (-5, -11, -1)), (50, (-6, -13, -2)), (0, (-6, -14, -2))),
        "PAM": ((201, (-8, -14, -2)), (121, (-7, -12, -1)), (31, (-6, -10, -1)), (0, (-5, -9, -1))),
    }
    own = {"BLOSUM45": (-5, -14, -2), "BLOSUM50": (-5, -13, -2), "BLOSUM62": (-4, -11, -1), "BLOSUM80": (-8, -10, -1), "BLOSUM90": (-6, -10, -1), "PAM30": (-9, -9, -1), "PAM70": (-10, -10, -1), "PAM250": (-8, -14, -2)}
    return own.get(name) or next((gaps for least, gaps in ladders.get(family, ()) if level >= least), (-5, -10, -2))


def from_ncbi_text(text: str, name: str | None = None, gap_score: int = -4, wildcard: str = "X", gap_open: int | None = None, gap_extend: int | None = None) -> Matrix:
    """Lines of a symbol and its scores under a header of symbols; lines that begin with # are comments."""
    lines = [line.split() for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
    if len(lines) < 2:
        raise ValueError("no header or no rows")
    header, rows = lines[0], lines[1:]
    if [r[0] for r in rows] != header:
        raise ValueError("the labels of the rows differ from the header")
    if any(len(r) != len(header) + 1 for r in rows):
        raise ValueError("a row has not as many scores as the header has symbols")
    return Matrix(name or "<unnamed>", "".join(header), [[int(c) for c in r[1:]] for r in rows], wildcard, gap_score, gap_open, gap_extend)


def from_npy(data: bytes | str, name: str = "KEYBOARD", alphabet: str = ASCII, wildcard: str | None = None, transpose: bool = False, gap_score: int = -1, gap_open: int | None = None, gap_extend: int | None = None) -> Matrix:
    """From a .npy file (its path or its bytes) of whole scores; wildcard: the alphabet's last symbol unless given."""
    grid = np.load(data if isinstance(data, str) else io.BytesIO(data), allow_pickle=False)
    return Matrix(name, alphabet, grid.T if transpose else grid, wildcard or alphabet[-1], gap_score, gap_open, gap_extend)


def from_confusion_counts(
    counts, alphabet: str = ASCII, name: str = "KEYBOARD", scale: float = 2.0, match_margin: int = 4, floor: float | None = None, wildcard: str | None = None,
    gap_score: int = -1, gap_open: int | None = None, gap_extend: int | None = None,
) -> Matrix:
    """Log-odds of typed (rows) for intended symbols (columns), from a mapping of pairs to counts or a square of counts.

    scale * log2(observed / expected), rounded half to even; pairs never seen score ``floor``, by default the least score
    seen. The diagonal is ``match_margin`` above the best of the rest, and above 0. Without counts: -1, and 1 on the diagonal.
    """
    n = len(alphabet)
    if isinstance(counts, dict):
        at, seen = {c: i for i, c in enumerate(alphabet)}, np.zeros((n, n))
        for (typed, intended), c in counts.items():
            if typed in at and intended in at:
                seen[at[typed], at[intended]] = c
    else:
        seen = np.asarray(counts, float)
    if seen.shape != (n, n):
        raise ValueError(f"{n} symbols need {n} x {n} counts")
    diagonal = np.eye(n, dtype=bool)
    if not seen.sum():
        grid = np.where(diagonal, 1, -1)
    else:
        with np.errstate(divide="ignore", invalid="ignore"):
            odds = scale * np.log2(seen * seen.sum() / (seen.sum(axis=1, keepdims=True) * seen.sum(axis=0, keepdims=True)))
        known = np.isfinite(odds)
        least = floor if floor is not None else np.floor(odds[known].min()) if known.any() else -1.0
        grid = np.clip(np.rint(np.where(known, odds, least)), -128, 127).astype(int)
        best = int(grid[~diagonal].max(initial=-128))
        grid[diagonal] = min(127, max(best, 0) + match_margin)
    return Matrix(name, alphabet, grid, wildcard or alphabet[-1], gap_score, gap_open, gap_extend)


_GENERATED = {"NUC.4.4": nucleotides, "DNA_MATCH": dna, "ASCII": ascii_text}


def available(directory: str | None = None) -> list[str]:
    """Names that load() takes: those made by rules, and NCBI text files of a directory."""
    found = {p.name for p in Path(directory).iterdir() if p.is_file() and not p.name.startswith((".", "_"))} if directory else set()
    return sorted({*_GENERATED, *found})


def load(name: str, directory: str | None = None) -> Matrix:
    """A matrix by name. BLOSUM, PAM and other tables are read as NCBI text from ``directory``; none are shipped."""
    if directory and (path := Path(directory, name)).is_file():
        gaps = default_gaps(name)
        return from_ncbi_text(path.read_text(encoding="utf-8"), name, gaps[0], "N" if name.startswith("NUC") else "X", *gaps[1:])
    if name in _GENERATED:
        return _GENERATED[name]()
    raise ValueError(f"no matrix {name!r}" + (f" in {directory}" if directory else "; pass the directory that has its NCBI text"))
