"""Parameters, their defaults, and the errors that operators raise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

#: Budget thresholds, product quantisation, centroid graph.
MU, TAU, EPSILON, THETA = 128, 256, 4, 39
PQ_M, PQ_CODES = 32, 256
HNSW_M, HNSW_EF_BUILD = 32, 1500
MAX_ID, MAX_DIM = 2**32 - 1, 4096


class EngineError(ValueError):
    """Any error of this library that a caller's input causes."""


def _error(name: str) -> type[EngineError]:
    return type(name, (EngineError,), {"__module__": __name__})


InvalidThresholds = _error("InvalidThresholds")
BudgetTooSmall = _error("BudgetTooSmall")
BudgetTooLarge = _error("BudgetTooLarge")
EmptyTokenDump = _error("EmptyTokenDump")
InvalidTokenDump = _error("InvalidTokenDump")
KmeansBudgetTooSmall = _error("KmeansBudgetTooSmall")
EmptyVectorSet = _error("EmptyVectorSet")
AllZero = _error("AllZero")
DimMismatch = _error("DimMismatch")
DimNotDivisibleByM = _error("DimNotDivisibleByM")
IndexCorrupt = _error("IndexCorrupt")
KappaCZero = _error("KappaCZero")
TopKExceedsKappaD = _error("TopKExceedsKappaD")
MalformedQrelsLine = _error("MalformedQrelsLine")
DuplicatePair = _error("DuplicatePair")
NoOverlap = _error("NoOverlap")
UnknownMetric = _error("UnknownMetric")
QidCountMismatch = _error("QidCountMismatch")
QidOutOfRange = _error("QidOutOfRange")
IndexExists = _error("IndexExists")
NoGraph = _error("NoGraph")
DropRateExceeded = _error("DropRateExceeded")


def ef_search(k):  # noqa: ANN001, ANN201
    """Width of a graph search for k results: of a number, or of a column."""
    return k * 3 // 2 if isinstance(k, int) else F.floor(k * 3 / 2).cast("long")


@dataclass(frozen=True)
class ClusteringParams:
    kappa: int = 4096
    mu: int = MU
    tau: int = TAU
    epsilon: int = EPSILON
    theta: int = THETA
    max_iters: int = 25
    tol: float = 1e-4
    seed: int = 42
    strict: bool = False

    def check(self) -> None:
        if not 0 < self.mu < self.tau:
            raise InvalidThresholds(f"mu {self.mu} and tau {self.tau} must satisfy 0 < mu < tau")
        if self.theta <= 0 or self.tau < self.epsilon * self.theta:
            raise InvalidThresholds("tau must be at least epsilon * theta, and theta positive")


@dataclass(frozen=True)
class SearchParams:
    kappa_c: int = 80
    kappa_d: int = 1000
    alpha: float | None = None
    top_k: int = 10

    def check(self) -> None:
        if self.kappa_c <= 0:
            raise KappaCZero("kappa_c must be positive")
        if self.top_k > self.kappa_d:
            raise TopKExceedsKappaD(f"top_k {self.top_k} is more than kappa_d {self.kappa_d}")
