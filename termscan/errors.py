"""Errors a caller may want to tell apart."""


class TermscanError(Exception):
    """Base of every error raised here."""


class NoCandidates(TermscanError):
    """No term is left to try on the first scan."""


class NoTermEntered(TermscanError):
    """The best term of the first scan does not reach the entry threshold.

    ``models`` and ``paths`` hold the results of other outcomes that were searched along with it.
    """

    def __init__(self, message: str, models: dict | None = None, paths: dict | None = None):
        super().__init__(message)
        self.models = models or {}
        self.paths = paths or {}


class IterationLimit(NoTermEntered):
    """A search did not end within the caller's limit; carries what the others found, and this one's state."""


class NotEnoughSamples(TermscanError):
    """The model has at least as many coefficients as there are samples."""


class SampleMismatch(TermscanError):
    """Two tables do not describe the same samples."""


class DuplicateTerms(TermscanError):
    """A term name occurs more than once."""


class BadShape(TermscanError):
    """A table is ragged, or cells are missing or repeated."""


class SingularModel(TermscanError):
    """The regressors of a model are linearly dependent."""


class TooManyColumns(TermscanError):
    """More columns than the driver may solve for at a time."""


class NotConverged(TermscanError):
    """An iteration stopped at its limit before it converged."""
