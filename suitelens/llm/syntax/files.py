"""Which source files do not parse in the language of their ending, and where each goes wrong."""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.resources import files as resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitelens.llm.syntax import java, markup, python3
from suitelens.llm.syntax.lalr import Recogniser, build
from suitelens.operators.spread import spread

#: ending: language
LANGUAGES = {"java": "java", "json": "json", "xml": "xml", "py": "python", "yml": "yaml", "yaml": "yaml"}
_LEXERS: dict[str, Callable] = {
    "java": java.tokens, "json": markup.json_tokens, "xml": markup.xml_tokens, "python": python3.tokens, "yaml": markup.yaml_tokens,
}
_ENDS = {"java": (";", "{", "}"), "python": ("NEWLINE",)}


class Parser:
    """One language: its lexer, and the tables that are built from its grammar once per process."""

    def __init__(self, language: str):
        text = (resources("suitelens.llm.syntax") / "grammars" / f"{language}.txt").read_text()
        self.language, self.lexer, self.cache = language, _LEXERS[language], {}
        tables = build(text)
        self.numbers = tables.terminals
        self.bad = len(self.numbers)
        self.run = Recogniser(tables, _ENDS.get(language, ()))

    def first_error(self, code: str) -> tuple[int, str] | None:
        """(line, kind of the token) of the first token that nothing valid could go on with; None if all parses."""
        kinds, at = self.lexer(code, self.cache)
        number, bad = self.numbers, self.bad
        try:
            coded = bytes([number[k] for k in kinds])
        except KeyError:
            coded = bytes([number.get(k, bad) for k in kinds])
        where = self.run.first_error(coded)
        if where is None:
            return None
        kind = kinds[where] if where < len(kinds) else "end of file"
        if where >= len(at):
            return code.count("\n") + 1, kind
        offset = at[where]
        if self.language == "java":
            offset = java.offset(code, offset)
        return code.count("\n", 0, offset) + 1, kind


@lru_cache(maxsize=None)
def parser(language: str) -> Parser:
    return Parser(language)


def _second_look(language: str, code: str, wrong: tuple[int, str] | None) -> tuple[int, str] | None:
    """What the tables say, once more looked at by the standard library where it knows the language.

    JSON: a rejection is withdrawn if the text is fine after all. Python: likewise, and what no context-free grammar tells
    (what can't be assigned to, the order of arguments, the inside of literals) is rejected where the tables accept.
    """
    try:
        if language == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(code)
        elif language == "json" and wrong:
            json.loads(code, parse_constant=lambda _: 1 / 0)
        else:
            return wrong
    except (RecursionError, MemoryError):
        return None  # nested deeper than it can say; the tables can't tell either whether a limit is meant
    except SyntaxError as e:
        return wrong or (e.lineno or 1, "not allowed here")
    except Exception:
        return wrong
    return None


def syntax_errors(df: DataFrame, id_column: str, path: str, code: str, keep: list[str] = ()) -> DataFrame:
    """(id, keep.., language, line, token): the files that do not parse, with the first token that is wrong.

    The language is that of the path's ending, whatever its case; other endings, null paths and null texts are no
    cases. Empty files are valid Java, Python and YAML, but not JSON or XML. Each file is read whole. A file that
    is listed twice is judged twice.
    """
    ending = F.lower(F.regexp_extract(F.col(path), r"\.([A-Za-z]+)\s*$", 1))
    known = df.select(id_column, *keep, ending.alias("_ending"), F.col(code).alias("_code")).filter(
        F.col("_code").isNotNull() & ending.isin(*LANGUAGES)
    )
    known = spread(known)
    names = [id_column, *keep, "language", "line", "token"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, languages, lines, kinds = [], [], [], []
            codes = batch.column(batch.num_columns - 1).to_pylist()
            for i, end in enumerate(batch.column(batch.num_columns - 2).to_pylist()):
                language = LANGUAGES[end]
                wrong = _second_look(language, codes[i], parser(language).first_error(codes[i]))
                if wrong:
                    rows.append(i)
                    languages.append(language)
                    lines.append(wrong[0])
                    kinds.append(wrong[1])
            taken = batch.take(pa.array(rows, pa.int64()))
            columns = [*taken.columns[:-2], pa.array(languages, pa.string()), pa.array(lines, pa.int64()), pa.array(kinds, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = known.drop("_ending", "_code").schema.add("language", "string").add("line", "long").add("token", "string")
    return known.mapInArrow(judge, schema)
