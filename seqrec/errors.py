"""Errors that validation raises."""


class SeqrecError(ValueError):
    """Base of the library's errors."""


class MissingColumns(SeqrecError):
    pass


class InvalidCodec(SeqrecError):
    pass


class DuplicateItem(InvalidCodec):
    pass


class DuplicateCode(InvalidCodec):
    pass


class InvalidArtifact(SeqrecError):
    pass


class UnknownItem(SeqrecError, KeyError):
    pass


class UnknownCode(SeqrecError, KeyError):
    pass
