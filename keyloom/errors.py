"""Errors of the key-value engine."""


class KeyloomError(Exception):
    """Base of all errors raised here."""


class TransactionActive(KeyloomError):
    """The operation needs a database without an open transaction."""


class NoValidPosition(KeyloomError):
    """A key that the operation needs is absent, or a hook vetoed the change."""


class NotSupported(KeyloomError):
    """The database's kind has no such operation."""


class KeyTooBig(KeyloomError):
    """A key or a database name is over its limit."""


class TypeMismatch(KeyloomError):
    """The database exists with another kind."""


class WrongValue(KeyloomError):
    """An argument is out of its domain."""


class WalError(KeyloomError):
    """The change log cannot be read back whole."""


class TransactionLost(KeyloomError):
    """Another handle ended the transaction: its lease was over, or the database was reset."""


class Conflict(KeyloomError):
    """Another handle replaced what the operation started from."""


class ReplicationFailed(KeyloomError):
    """A replication session ended in an error; `code` names its kind."""

    def __init__(self, code: str, reason: str):
        super().__init__(f"{code}: {reason}")
        self.code = code
