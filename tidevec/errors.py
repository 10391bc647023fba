"""Errors of the vector index, its corpus files and the accelerator registry."""

from __future__ import annotations


class TidevecError(Exception):
    """Base of all errors; code is a stable short name."""

    code = "error"


class NotInitialised(TidevecError):
    """The index has not been created or was dropped."""

    code = "not_initialised"


class EmptyIndex(TidevecError):
    """A search or save on an index without vectors."""

    code = "empty"


class WrongDimension(TidevecError):
    """A vector of another length than the index, or a null one."""

    code = "wrong_dimension"


class CapacityExceeded(TidevecError):
    """An append beyond the capacity; kept says how many rows went in before it."""

    code = "capacity"

    def __init__(self, message: str, kept: int = 0):
        super().__init__(message)
        self.kept = kept


class KTooLarge(TidevecError):
    """More neighbours asked for than there are vectors."""

    code = "k_too_large"


class CorpusError(TidevecError):
    """A corpus file that cannot be read."""

    code = "io"


class SchedulingError(TidevecError):
    """Base of what placement refuses."""


class NoneFree(SchedulingError):
    code = "none_free"


class MemoryTooSmall(SchedulingError):
    code = "memory_too_small"


class BadJob(SchedulingError):
    code = "bad_job"


class RegistryFull(SchedulingError):
    code = "full"


class NotFound(SchedulingError):
    code = "not_found"


class NoRunner(SchedulingError):
    code = "no_runner"
