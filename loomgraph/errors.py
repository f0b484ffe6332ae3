"""Errors that queries raise before anything runs."""

from __future__ import annotations


class CypherError(Exception):
    """Base of all query errors; `code` names the kind."""

    code = "Error"

    def __init__(self, message: str):
        super().__init__(f"{self.code}: {message}")


class SyntaxFault(CypherError):
    code = "SyntaxError"


class SemanticFault(CypherError):
    code = "SemanticError"


class TypeFault(CypherError):
    code = "TypeError"


class ArgumentFault(CypherError):
    code = "ArgumentError"


class UnsupportedFault(CypherError):
    code = "Unsupported"


class ConstraintFault(CypherError):
    code = "ConstraintVerificationFailed"


class PolicyFault(CypherError):
    code = "PolicyDenied"
