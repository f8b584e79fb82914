"""What can go wrong with a sketch."""


class SketchError(Exception):
    """Base class."""


class InvalidOption(SketchError, ValueError):
    """An option is out of its range."""


class IncompatibleSketches(SketchError, ValueError):
    """Two sketches' parameters or hashes differ."""


class DeserializationError(SketchError, ValueError):
    """A frame is damaged, unknown or of another family."""


class UnsupportedOperation(SketchError, TypeError):
    """The family has no such operation."""


class InvalidChainComposition(SketchError, ValueError):
    """Stages can't follow one another."""


class NotImplementedForFormat(SketchError, NotImplementedError):
    """The foreign format isn't written for this family."""


def check(ok: bool, message: str) -> None:
    if not ok:
        raise InvalidOption(message)
