"""Fixed values of the domain: word lists, extensions and label tables.

Every list here is a fixed value that results depend on; expressions and checking SQL are
generated from the same list, so the two cannot drift apart.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Links by file extension.
DOCUMENT_EXTENSIONS = (".pdf", ".doc", ".docx", ".ppt", ".pptx")
EXCLUDED_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".bmp", ".tiff",
    ".zip", ".rar", ".tar", ".gz", ".xls", ".xlsx", ".csv", ".txt", ".xml", ".json", ".js", ".css",
    ".mp4", ".mp3", ".avi", ".mov", ".wmv", ".flv", ".webm",
    ".woff", ".woff2", ".ttf", ".eot", ".otf",
)
QUERY_IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg")
FILTER_IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp")

# Link scoring.
HIGH_PRIORITY_WORDS = (
    "quem-somos", "sobre", "institucional",
    "portfolio", "produto", "servico", "solucoes", "atuacao", "tecnologia",
    "catalogo", "catalogo-digital", "catalogo-online", "produtos", "servicos",
    "clientes", "cases", "projetos", "obras", "certificacoes", "premios", "parceiros",
    "equipe", "time", "lideranca", "contato", "fale-conosco", "unidades",
)
LOW_PRIORITY_WORDS = ("login", "signin", "cart", "policy", "blog", "news", "politica-privacidade", "termos")
PAGING_WORDS = ("page", "p=", "pagina", "nav")
LOW_PENALTY, HIGH_BONUS, PAGING_BONUS, LOWEST_SCORE = -100, 50, 30, -80


def one_of(words: tuple[str, ...]) -> str:
    """A regular expression for any of the words, so that the tested column is evaluated once."""
    return "(?:" + "|".join(re.sub(r"([^A-Za-z0-9 ])", r"[\1]", w) if w.isascii() else w for w in words) + ")"


def contains_any(column: Column, words: tuple[str, ...]) -> Column:
    """True where any word occurs in the column; null stays null."""
    return column.rlike(one_of(words))


def ends_with_any(column: Column, endings: tuple[str, ...]) -> Column:
    return column.rlike(one_of(endings) + r"\z")


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_contains_any(expression: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({expression}, {quote(w)})" for w in words) + ")"


def sql_ends_with_any(expression: str, endings: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"suffix({expression}, {quote(w)})" for w in endings) + ")"


def ladder(column: Column, steps: list[tuple[Column, str]], default: str) -> Column:
    """First matching step's label."""
    out = None
    for condition, label in steps:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(default)
