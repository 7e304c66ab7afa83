"""Diagnostics: what is wrong with a query or statement, found before anything runs."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Code(Enum):
    """The diagnostic codes of the compiler."""

    UNKNOWN = "unknown"
    UNSUPPORTED_FEATURE = "unsupported_feature"
    UNSUPPORTED_TYPE = "unsupported_type"
    AMBIGUOUS_TYPE = "ambiguous_type"
    INCONSISTENT_TYPE = "inconsistent_type"
    UNRESOLVED_VARIABLE = "unresolved_variable"
    INCONSISTENT_ELEMENTS = "inconsistent_elements"
    INCONSISTENT_FUNCTION_TYPE = "inconsistent_function_type"


@dataclass(frozen=True)
class Diagnostic:
    code: Code
    message: str
    region: str = ""

    def __str__(self) -> str:
        return f"{self.code.value}: {self.message}" + (f" (in {self.region})" if self.region else "")


class CompileError(Exception):
    """Raised with one or more diagnostics."""

    def __init__(self, *diagnostics: Diagnostic):
        super().__init__("; ".join(map(str, diagnostics)))
        self.diagnostics = list(diagnostics)

    @property
    def code(self) -> Code:
        return self.diagnostics[0].code


def fail(code: Code, message: str, region: str = "") -> CompileError:
    return CompileError(Diagnostic(code, message, region))
