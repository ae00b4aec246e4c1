"""Predicates and derived fields of a call-log row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulario.functions.text import filled, is_blank

# Menus that end a call without service, and menus that complete one.
FAILED_MENUS = ("cte_colgo", "SinOpcion_Cbc")
SUCCESS_MENUS = ("CONFIRMACION", "EXITO", "COMPLETADO")


def inverted() -> Column:
    return F.col("hora_fin_seg") < F.col("hora_inicio_seg")


def start() -> Column:
    """Start second with inverted times swapped back."""
    return F.least("hora_inicio_seg", "hora_fin_seg")


def end() -> Column:
    return F.greatest("hora_inicio_seg", "hora_fin_seg")


def seconds() -> Column:
    """Duration after repairing inverted times."""
    return F.abs(F.col("hora_fin_seg") - F.col("hora_inicio_seg"))


def raw_seconds() -> Column:
    """Duration as recorded; negative for inverted times."""
    return F.col("hora_fin_seg") - F.col("hora_inicio_seg")


def hour() -> Column:
    """Hour of the day of the recorded start."""
    return F.floor(F.col("hora_inicio_seg") / 3600).cast("int")


def caller() -> Column:
    return F.col("numero_entrada")


def dialled() -> Column:
    return F.col("numero_digitado")


def equal() -> Column:
    return caller() == dialled()


def different() -> Column:
    """Strict: a NULL dialled number is neither equal nor different."""
    return caller() != dialled()


def transfer(mode: str = "null_kept") -> Column:
    """Row predicate of a transfer; NULL callers never qualify.

    strict:         dialled number known and different
    null_kept:      a missing dialled number counts as the empty text
    explicit_null:  different, or dialled number missing
    trimmed:        as null_kept, ignoring surrounding blanks and blank callers
    """
    known = caller().isNotNull()
    if mode == "strict":
        return known & dialled().isNotNull() & different()
    if mode == "null_kept":
        return known & (caller() != F.coalesce(dialled(), F.lit("")))
    if mode == "explicit_null":
        return known & (dialled().isNull() | different())
    if mode == "trimmed":
        return known & (F.trim(caller()) != F.coalesce(F.trim(dialled()), F.lit(""))) & (F.trim(caller()) != "")
    raise ValueError(f"unknown transfer mode: {mode}")


TRANSFER_MODES = ("strict", "null_kept", "explicit_null", "trimmed")


def redirected() -> Column:
    return filled(F.col("id_CTransferencia"))


def labelled() -> Column:
    return filled(F.col("etiquetas"))


def unlabelled() -> Column:
    return is_blank(F.col("etiquetas"))


def has_label(text: str) -> Column:
    """Substring test on the label list; false for a missing list."""
    return F.coalesce(F.col("etiquetas").contains(text), F.lit(False))


def option_reflected() -> Column:
    """The option occurs inside the label list (wildcards in the option stay wildcards)."""
    return F.coalesce(F.expr("etiquetas like concat('%', opcion, '%')"), F.lit(False))


def failed() -> Column:
    return F.coalesce(F.col("menu").isin(*FAILED_MENUS), F.lit(False))


def success() -> Column:
    return F.coalesce(F.col("menu").isin(*SUCCESS_MENUS), F.lit(False))


def menu_option(sep: str = ":") -> Column:
    """Menu and option; NULL when either is missing."""
    return F.concat("menu", F.lit(sep), "opcion")


def location() -> Column:
    return F.concat("division", F.lit("-"), "area")


def kind() -> Column:
    """OFICIAL when caller and dialled number are equal, DERIVADO otherwise (also for a missing number)."""
    return F.when(equal(), "OFICIAL").otherwise("DERIVADO")


def step(arrow: str = ":") -> Column:
    """Menu and option as one step text; missing parts are empty."""
    return F.concat(F.coalesce("menu", F.lit("")), F.lit(arrow), F.coalesce("opcion", F.lit("")))
