"""Scalar functions as SQL text, in Spark's words and in DuckDB's.

The library's expressions are plain SQL: Spark plans and compiles them like any column.
``SPARK`` writes what the jobs run, ``DUCK`` what the comparison runs.
"""

from __future__ import annotations


class Dialect:
    """Spark SQL; regular expressions as raw strings."""

    name = "spark"
    text_type, integer = "string", "bigint"

    def pattern(self, p: str) -> str:
        return "r'" + p.replace("'", "\\x27") + "'"

    def text(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def replace(self, x: str, p: str, to: str = "") -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, {self.text(to)})"

    def extract(self, x: str, p: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.pattern(p)}, {group})"

    def like(self, x: str, p: str) -> str:
        return f"({x} rlike {self.pattern(p)})"

    def all(self, x: str, p: str, group: int = 1) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)}, {group})"

    def number(self, x: str) -> str:
        return f"try_cast({x} as double)"

    def whole(self, x: str) -> str:
        return f"try_cast({x} as bigint)"

    def lambda_(self, function: str, array: str, v: str, body: str) -> str:
        return f"{function}({array}, {v} -> {body})"

    def filter(self, array: str, v: str, body: str) -> str:
        return self.lambda_("filter", array, v, body)

    def map(self, array: str, v: str, body: str) -> str:
        return self.lambda_("transform", array, v, body)

    def any(self, array: str, v: str, body: str) -> str:
        return self.lambda_("exists", array, v, body)

    def join(self, array: str, by: str) -> str:
        return f"array_join({array}, {self.text(by)})"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, {self.pattern(by)})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def size(self, x: str) -> str:
        return f"size({x})"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def at(self, array: str, k: int) -> str:
        return f"get({array}, {k - 1})"


class Duck(Dialect):
    name = "duck"
    text_type = "varchar"

    def pattern(self, p: str) -> str:
        return "'" + p.replace("(?U)", "").replace("'", "''") + "'"

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''").replace("$1", "\\1").replace("$2", "\\2") + "'" if "\n" not in s else "'" + s.replace("'", "''") + "'"

    def replace(self, x: str, p: str, to: str = "") -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, {self.text(to)}, 'g')"

    def like(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.pattern(p)})"

    def lambda_(self, function: str, array: str, v: str, body: str) -> str:
        return f"{function}({array}, lambda {v}: {body})"

    def filter(self, array: str, v: str, body: str) -> str:
        return self.lambda_("list_filter", array, v, body)

    def map(self, array: str, v: str, body: str) -> str:
        return self.lambda_("list_transform", array, v, body)

    def any(self, array: str, v: str, body: str) -> str:
        return f"(len(list_filter({array}, lambda {v}: {body})) > 0)"

    def join(self, array: str, by: str) -> str:
        return f"array_to_string({array}, {self.text(by)})"

    def split(self, x: str, by: str) -> str:
        return f"regexp_split_to_array({x}, {self.pattern(by)})"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def size(self, x: str) -> str:
        return f"len({x})"

    def div(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def at(self, array: str, k: int) -> str:
        return f"({array})[{k}]"


SPARK, DUCK = Dialect(), Duck()
