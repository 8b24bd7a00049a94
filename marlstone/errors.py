"""What can go wrong with a statement."""


class EngineError(Exception):
    """Any failure of a statement; the database is as it was before."""


class ParseError(EngineError):
    """The text is no statement of the grammar."""


class UnknownTableError(EngineError):
    pass


class UnknownColumnError(EngineError):
    pass


class AmbiguousColumnError(EngineError):
    """A name that more than one table of the query has."""


class DuplicateNameError(EngineError):
    pass


class TypeMismatchError(EngineError):
    pass


class ValueRangeError(EngineError):
    """A number outside its type or a string longer than its column."""


class ArityError(EngineError):
    """As many values as columns are needed."""


class LockTimeoutError(EngineError):
    pass


class ConflictError(EngineError):
    """Another writer has changed the same thing meanwhile."""


class WrongStatementError(EngineError):
    """A query given to execute_update, or the other way round."""
