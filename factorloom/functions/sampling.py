"""Draws of the model's random parts in numpy; every draw is a function of its key alone."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np


def generator(*key: int) -> np.random.Generator:
    """A counter-based generator for a key of small integers."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([k & 0xFFFFFFFF for k in key])))


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers over all 64 bits (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def noise(ids: np.ndarray, k: int, *key: int) -> np.ndarray:
    """Standard normals, a row of k for each id, by the key and the id: independent of partitions, batches and order."""
    state = np.array([0x9E3779B97F4A7C15], np.uint64)
    for part in key:
        state = scramble(state + np.array([part & 0xFFFFFFFFFFFFFFFF], np.uint64))
    row = scramble(np.asarray(ids).astype(np.int64).view(np.uint64) + state)
    cell = scramble(row[:, None] * np.uint64(2) + np.arange(1, 2 * k + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1342543DE82EF95))
    u = ((cell >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
    return np.sqrt(-2 * np.log(u[:, :k])) * np.cos(2 * np.pi * u[:, k:])


class Draws:
    """Where a fit's randomness comes from; each draw is a function of its key."""

    def generator(self, *key: int):
        return generator(*key)

    def noise(self, ids: np.ndarray, k: int, *key) -> np.ndarray:
        return noise(ids, k, *key)


class PortableDraws(Draws):
    """Draws from md5 sums, which any engine can repeat (`columns.normal_sql`): slower, and for tests. Chi-square draws are Wilson and Hilferty's cubes of normals."""

    @staticmethod
    def uniform(ident, *key) -> float:
        return (int(hashlib.md5(f"{':'.join(map(str, key))}:{ident}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)

    @classmethod
    def normal(cls, ident, *key) -> float:
        return float(np.sqrt(-2 * np.log(cls.uniform(ident, *key, "a"))) * np.cos(2 * np.pi * cls.uniform(ident, *key, "b")))

    def noise(self, ids: np.ndarray, k: int, *key) -> np.ndarray:
        return np.array([[self.normal(i, *key, j) for j in range(k)] for i in np.asarray(ids).tolist()]).reshape(-1, k)

    def generator(self, *key: int):
        return PortableGenerator(key)


@dataclass
class PortableGenerator:
    """Normals numbered in the order in which they are asked for."""

    key: tuple
    n: int = 0

    def standard_normal(self, size) -> np.ndarray:
        count = int(np.prod(size))
        self.n += count
        return np.array([PortableDraws.normal(i, "g", *self.key) for i in range(self.n - count, self.n)]).reshape(size)

    def chisquare(self, df: np.ndarray) -> np.ndarray:
        df = np.asarray(df, float)
        return df * (1 - 2 / (9 * df) + self.standard_normal(df.shape) * np.sqrt(2 / (9 * df))) ** 3


def solve_lower(lower: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x with lower x = right, for a batch of lower triangles, row by row."""
    x = np.array(right, float)
    for i in range(x.shape[-1]):
        x[..., i] = (x[..., i] - np.einsum("...j,...j->...", lower[..., i, :i], x[..., :i])) / lower[..., i, i]
    return x


def solve_upper(upper: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x with upper x = right, for a batch of upper triangles."""
    return solve_lower(upper[..., ::-1, ::-1], right[..., ::-1])[..., ::-1]


def mvn_precision(rng: np.random.Generator, mean: np.ndarray, upper: np.ndarray, kappa: float = 1.0) -> np.ndarray:
    """Normal with precision kappa * upper' upper."""
    return mean + solve_upper(upper, rng.standard_normal(len(mean))) / np.sqrt(kappa)


def wishart_unit_upper(rng: np.random.Generator, df: float, k: int) -> np.ndarray:
    """Bartlett's factor: an upper triangle whose U'U is Wishart with unit scale."""
    upper = np.triu(rng.standard_normal((k, k)), 1)
    upper[np.diag_indices(k)] = np.sqrt(rng.chisquare(df - np.arange(k)))
    return upper


def wishart_upper(rng: np.random.Generator, scale: np.ndarray, df: float) -> np.ndarray:
    """An upper factor U with U'U Wishart of the given scale and degrees of freedom."""
    return wishart_unit_upper(rng, df, len(scale)) @ np.linalg.cholesky(scale).T


@dataclass(frozen=True)
class NormalWishart:
    """mean, kappa, scale (of the precision) and degrees of freedom."""

    mean: np.ndarray
    kappa: float
    scale: np.ndarray
    df: float

    @staticmethod
    def prior(k: int, kappa: float = 2.0) -> NormalWishart:
        return NormalWishart(np.zeros(k), kappa, np.eye(k), float(k))

    def given(self, n: int, mean: np.ndarray, covariance: np.ndarray) -> NormalWishart:
        """The posterior after n vectors with that mean and sample covariance."""
        if n == 0:
            return self
        off = self.mean - mean
        scale = np.linalg.inv(np.linalg.inv(self.scale) + n * covariance + self.kappa * n / (self.kappa + n) * np.outer(off, off))
        return NormalWishart((self.kappa * self.mean + n * mean) / (self.kappa + n), self.kappa + n, (scale + scale.T) / 2, self.df + n)

    def draw(self, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """A mean and a precision matrix."""
        upper = wishart_upper(rng, self.scale, self.df)
        return mvn_precision(rng, self.mean, upper, self.kappa), upper.T @ upper


def symmetric(packed: np.ndarray, k: int) -> np.ndarray:
    """Matrices from rows of upper triangles, row by row."""
    out = np.empty((*packed.shape[:-1], k, k))
    i, j = np.triu_indices(k)
    out[..., i, j] = packed
    out[..., j, i] = packed
    return out


def posterior_factors(gram: np.ndarray, precision: np.ndarray, alpha: float) -> np.ndarray:
    """Lower Cholesky factors of the posterior precisions; LinAlgError where one isn't positive definite."""
    return np.linalg.cholesky(precision + alpha * gram)


def posterior_draws(gram: np.ndarray, rr: np.ndarray, mean: np.ndarray, precision: np.ndarray, alpha: float, z: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Draw one vector for each row: precision* = precision + alpha gram, its mean solves precision* m = precision mean + alpha rr."""
    right = np.einsum("...ij,...j->...i", precision, mean) + alpha * rr
    if diagonal:
        d = np.einsum("...ii->...i", precision + alpha * gram)
        return right / d + z / np.sqrt(d)
    lower = posterior_factors(gram, precision, alpha)
    return solve_upper(np.swapaxes(lower, -1, -2), solve_lower(lower, right) + z)
