"""Errors, one class for each rule that can be broken."""


class WeftError(Exception):
    """Base of all errors of this package."""

    def __init__(self, **details):
        self.details = details
        super().__init__(f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in details.items())})")


class BuildError(WeftError):
    """A graph can't be built."""


class DuplicateNode(BuildError): ...


class DuplicateEdge(BuildError): ...


class MissingEndpoint(BuildError): ...


class DuplicateLocalId(BuildError): ...


class UndefinedRef(BuildError): ...


class PatternError(WeftError):
    """A pattern breaks a rule."""


class PatternDuplicateId(PatternError): ...


class PatternUndefinedRef(PatternError): ...


class ContextOnlyInBan(PatternError): ...


class NodeNotInAnyCluster(PatternError): ...


class PatternDuplicateEdge(PatternError): ...


class ConflictingPredicate(PatternError): ...


class IsoNotSole(PatternError): ...


class RedundantInBan(PatternError): ...


class CoveredByGet(PatternError): ...


class Contradictory(PatternError): ...


class Subsumed(PatternError): ...


class BoundPatternInSession(PatternError): ...


class TargetMissing(PatternError): ...


class BindError(WeftError):
    """A table of bindings doesn't fit a pattern."""


class BindNotFound(BindError): ...


class BindDuplicate(BindError): ...


class BindMissing(BindError): ...


class BindCollision(BindError): ...


class FragmentError(WeftError):
    """A modification contradicts itself."""


class DuplicateNew(FragmentError): ...


class UndefinedNewRef(FragmentError): ...


class DuplicateExist(FragmentError): ...


class RemoveConflict(FragmentError): ...


class DuplicateTranslated(FragmentError): ...


class UndefinedTranslatedRef(FragmentError): ...


class TranslatedRemoveConflict(FragmentError): ...


class ApplyError(WeftError):
    """A modification doesn't fit the graph."""


class NodeNotFound(ApplyError): ...


class EdgeNotFound(ApplyError): ...


class EdgeExists(ApplyError): ...


class CascadeConflict(ApplyError): ...


class SwapConflict(ApplyError): ...


class PersistError(WeftError):
    """A snapshot can't be loaded as asked."""


class ParseError(WeftError):
    """A textual pattern can't be read."""
