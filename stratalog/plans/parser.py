"""Recursive-descent parser of the pipe query language.

    level:="error" duration:>10 | stats by (service.name) count() rows | sort by (rows desc)

A query that does not parse raises `QueryError` with the place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.text import checked_regexp
from .ast import Aggregate, All, And, InQuery, Leaf, Not, Or, Pipe, Query, Stream


class QueryError(ValueError):
    """A query that cannot be parsed or compiled."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, text, sym, end
    value: str
    start: int
    end: int


_TOKEN = re.compile(
    r"""\s+|#[^\n]*|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)|(?P<word>[^\s"'`|(){}\[\],:=~!<>*+/^%]+)|(?P<sym>!=|!~|=~|>=|<=|[|(){}\[\],:=~!<>*+/^%])""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
#: Filter functions after `field:` that take a list of texts.
_LISTS = {"in": "in", "contains_all": "contains_all", "contains_any": "contains_any", "seq": "seq", "equals_common_case": "equals_common_case", "contains_common_case": "contains_common_case", "json_array_contains_any": "json_array_contains_any"}
_PAIRS = {"len_range", "string_range"}
_ONE_FIELD = {"eq_field", "le_field", "lt_field"}
_STATS = {"count", "count_empty", "count_uniq", "count_uniq_hash", "sum", "avg", "min", "max", "median", "quantile", "values", "uniq_values", "any", "row_any", "sum_len", "histogram", "stddev"}


def _unquote(raw: str) -> str:
    if raw[0] == "`":
        return raw[1:-1]
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1] if m[1] in "\"'\\" else "\\" + m[1]), raw[1:-1], flags=re.S)


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"cannot read {text[at : at + 10]!r} at {at}")
        kind = m.lastgroup
        if kind:
            raw = m[kind]
            out.append(Token(kind, _unquote(raw) if kind == "text" else raw, m.start(), m.end()))
        at = m.end()
    out.append(Token("end", "", len(text), len(text)))
    return out


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokenize(text), 0

    # Tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, ahead: int = 1) -> Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def take(self) -> Token:
        t = self.now
        self.at += t.kind != "end"
        return t

    def is_sym(self, *values: str) -> bool:
        return self.now.kind == "sym" and self.now.value in values

    def is_word(self, *values: str) -> bool:
        return self.now.kind == "word" and self.now.value.lower() in values

    def accept(self, value: str) -> bool:
        if (self.now.kind == "sym" and self.now.value == value) or (self.now.kind == "word" and self.now.value.lower() == value):
            self.at += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.accept(value):
            raise self.error(f"expected {value!r}")

    def error(self, what: str) -> QueryError:
        return QueryError(f"{what} at {self.now.start}, found {self.now.value or 'the end'!r} in {self.text!r}")

    def touching(self) -> bool:
        """Whether the next token follows the last without white space."""
        return self.at > 0 and self.tokens[self.at - 1].end == self.now.start

    def name(self) -> str:
        """A field name: a text, or words joined by colons without white space."""
        if self.now.kind not in ("word", "text"):
            raise self.error("expected a field name")
        t = self.take()
        out = t.value
        while t.kind == "word" and out in ("resource_attr", "log_attr", "span_attr", "scope_attr") and self.is_sym(":"):
            self.take()
            t = self.take()
            out += ":" + t.value
        return out

    def value(self) -> str:
        """A text, or tokens up to white space or a closing sign."""
        if self.now.kind == "text":
            return self.take().value
        first = self.now.start
        end = first
        while self.now.kind in ("word", "sym", "text") and not self.is_sym(")", "]", ",", "|", "}") and (self.now.start == first or self.touching()):
            end = self.take().end
        if end == first:
            raise self.error("expected a value")
        return self.text[first:end]

    # Query

    def query(self) -> Query:
        q = self.pipeline()
        if self.now.kind != "end":
            raise self.error("expected a pipe or the end")
        return q

    def pipeline(self) -> Query:
        start = self.filter()
        pipes = []
        while self.accept("|"):
            pipes.append(self.pipe())
        return Query(start, tuple(pipes))

    # Filters

    def filter(self):
        parts = [self.conjunction()]
        while self.accept("or"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def conjunction(self):
        parts = [self.negation()]
        while self.accept("and") or self.starts_filter():
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def starts_filter(self) -> bool:
        return self.now.kind == "text" or (self.now.kind == "word" and not self.is_word("or")) or self.is_sym("(", "{", "!", "*")

    def negation(self):
        if self.accept("not") or self.accept("!"):
            return Not(self.negation())
        return self.primary()

    def primary(self):
        if self.accept("("):
            inside = self.filter()
            self.expect(")")
            return inside
        if self.is_sym("{"):
            return self.stream()
        if self.accept("*"):
            return All()
        if self.now.kind not in ("word", "text"):
            raise self.error("expected a filter")
        t = self.now
        if t.kind == "word" and t.value.startswith("-") and len(t.value) > 1 and not re.match(r"-[\d.]", t.value):
            self.tokens[self.at] = Token("word", t.value[1:], t.start + 1, t.end)
            return Not(self.primary())
        if self.peek().kind == "sym" and self.peek().value == ":":
            name = self.name()
            self.expect(":")
            return self.test(name)
        return self.plain("_msg")

    def plain(self, field: str):
        """A phrase, a prefix if a star follows directly, or any value."""
        if self.accept("*"):
            return Leaf(field, "exists")
        t = self.take()
        if t.kind not in ("word", "text"):
            raise self.error("expected a word or phrase")
        word = t.value
        while t.kind == "word" and self.touching() and self.now.kind in ("word", "sym") and not self.is_sym(")", "]", "|", ",", "}", "*", "("):
            word += self.take().value
        if self.is_sym("*") and self.touching():
            self.take()
            return Leaf(field, "prefix", (word,))
        return Leaf(field, "phrase", (word,))

    def test(self, field: str):
        if field == "_time":
            return self.time_test()
        if field == "_stream":
            if self.is_sym("{"):
                return self.stream()
        if self.accept("("):
            inside = self.grouped(field)
            self.expect(")")
            return inside
        if self.accept("!"):
            return Not(self.test(field))
        if self.accept("="):
            if self.accept("~"):
                return Leaf(field, "regexp", (checked_regexp(self.value()),))
            v = self.value_or_prefix()
            return Leaf(field, *v)
        if self.accept("!="):
            op, args = self.value_or_prefix()
            return Not(Leaf(field, op, args))
        for sign in ("~", "=~"):
            if self.accept(sign):
                return Leaf(field, "regexp", (checked_regexp(self.value()),))
        if self.accept("!~"):
            return Not(Leaf(field, "regexp", (checked_regexp(self.value()),)))
        for sign, op in ((">=", "ge"), ("<=", "le"), (">", "gt"), ("<", "lt")):
            if self.accept(sign):
                if self.accept("="):
                    op = {"gt": "ge", "lt": "le"}[op]
                return Leaf(field, op, (self.value(),))
        if self.now.kind == "word" and self.peek().kind == "sym" and self.peek().value in "([" and self.peek().start == self.now.end:
            return self.function(field)
        return self.plain(field)

    def value_or_prefix(self) -> tuple[str, tuple[str, ...]]:
        if self.now.kind == "text":
            raw = self.text[self.now.start : self.now.end]
            v = self.take().value
            if self.is_sym("*") and self.touching():
                self.take()
                return "exact_prefix", (v,)
            # A star just inside the quotes marks a prefix too.
            return ("exact_prefix", (v[:-1],)) if raw.endswith('*"') and len(v) > 1 else ("exact", (v,))
        v = self.value()
        return ("exact_prefix", (v[:-1],)) if v.endswith("*") and len(v) > 1 else ("exact", (v,))

    def grouped(self, field: str):
        """A filter in parentheses after `field:`, whose plain tests are of that field."""

        def any_of():
            parts = [all_of()]
            while self.accept("or"):
                parts.append(all_of())
            return parts[0] if len(parts) == 1 else Or(tuple(parts))

        def all_of():
            parts = [one()]
            while self.accept("and") or self.starts_filter() or self.is_sym("=", "~", ">", "<", ">=", "<="):
                parts.append(one())
            return parts[0] if len(parts) == 1 else And(tuple(parts))

        def one():
            if self.accept("not") or self.accept("!"):
                return Not(one())
            if self.accept("("):
                inside = any_of()
                self.expect(")")
                return inside
            return self.test(field)

        return any_of()

    def function(self, field: str):
        name = self.take().value.lower()
        opened = self.take().value
        if name == "in" and opened == "(" and self.looks_like_query():
            query = self.pipeline()
            self.expect(")")
            return InQuery(field, query)
        if name in ("range", "day_range", "week_range"):
            low = self.value()
            self.expect(",")
            high = self.value()
            return Leaf(field, name, (low, high), (opened == "[", self.closing()))
        if name == "i":
            v = self.take().value
            prefix = self.accept("*")
            self.expect(")")
            return Leaf(field, "any_case_prefix" if prefix else "any_case_phrase", (v,))
        args = []
        while not self.is_sym(")"):
            args.append(self.name() if name in _ONE_FIELD else self.value())
            if not self.accept(","):
                break
        self.expect(")")
        if name in _LISTS:
            return Leaf(field, _LISTS[name], tuple(args))
        if name in _PAIRS and len(args) == 2 or name in _ONE_FIELD and len(args) == 1 or name in ("ipv4_range", "ipv6_range") and 1 <= len(args) <= 2 or name in ("pattern_match", "pattern_match_full", "substring", "exact") and len(args) == 1:
            return Leaf(field, name, tuple(args))
        if name == "value_type":
            raise QueryError("value_type depends on a storage encoding that does not exist here")
        raise self.error(f"unknown filter {name}() or wrong number of arguments")

    def closing(self) -> bool:
        if self.accept("]"):
            return True
        self.expect(")")
        return False

    def looks_like_query(self) -> bool:
        """Whether the parentheses hold a query: it has a pipe at their own depth."""
        depth, k = 0, self.at
        while (t := self.tokens[k]).kind != "end":
            if t.kind == "sym":
                depth += (t.value in "([{") - (t.value in ")]}")
                if depth < 0:
                    return False
                if t.value == "|" and depth == 0:
                    return True
            k += 1
        return False

    def stream(self) -> Stream:
        self.expect("{")
        groups, group = [], []
        while not self.accept("}"):
            tag = self.name()
            op = next((s for s in ("=~", "!~", "!=", "=") if self.accept(s)), None)
            if op == "=" and self.accept("~"):
                op = "=~"
            if op is None:
                if self.is_word("in", "not_in"):
                    word = self.take().value
                    self.expect("(")
                    vals = [self.value()]
                    while self.accept(","):
                        vals.append(self.value())
                    self.expect(")")
                    group.append((tag, word, "\x00".join(vals)))
                    self.accept(",")
                    continue
                raise self.error("expected =, !=, =~ or !~")
            group.append((tag, op, self.value()))
            if self.accept("or"):
                groups.append(tuple(group))
                group = []
            else:
                self.accept(",")
        groups.append(tuple(group))
        return Stream(tuple(groups))

    def time_test(self) -> Leaf:
        """_time:5m, _time:[a, b], _time:day_range[...], _time:>x; times hold colons, so they are cut from the text."""
        rest = self.text[self.now.start :]
        if m := re.match(r"(day_range|week_range)\s*([\[(])\s*([^,\])]+?)\s*,\s*([^\])]+?)\s*([\])])", rest):
            self.skip_to(self.now.start + m.end())
            return Leaf("_time", m[1], (m[3], m[4]), (m[2] == "[", m[5] == "]"))
        if m := re.match(r"([\[(])\s*([^,\])]+?)\s*,\s*([^\])]+?)\s*([\])])", rest):
            self.skip_to(self.now.start + m.end())
            return Leaf("_time", "time_range", (m[2], m[3]), (m[1] == "[", m[4] == "]"))
        if m := re.match(r"(>=|<=|>|<)\s*([^\s|)]+)", rest):
            self.skip_to(self.now.start + m.end())
            return Leaf("_time", "time_" + {">=": "ge", "<=": "le", ">": "gt", "<": "lt"}[m[1]], (m[2],))
        if m := re.match(r"([^\s|)]+)(?:\s+offset\s+([^\s|)]+))?", rest):
            self.skip_to(self.now.start + m.end())
            return Leaf("_time", "time", (m[1], m[2] or ""))
        raise self.error("expected a time")

    def skip_to(self, place: int) -> None:
        while self.now.kind != "end" and self.now.start < place:
            self.at += 1

    # Pipes

    def names(self) -> tuple[str, ...]:
        """Names separated by commas, in parentheses or bare."""
        inside = self.accept("(")
        out = []
        while self.now.kind in ("word", "text"):
            out.append(self.name())
            if not self.accept(","):
                break
        if inside:
            self.expect(")")
        return tuple(out)

    def number(self) -> int:
        if not (self.now.kind == "word" and self.now.value.isdigit()):
            raise self.error("expected a number")
        return int(self.take().value)

    def pipe(self) -> Pipe:
        if self.now.kind != "word":
            return Pipe("filter", {"filter": self.filter()})
        t = self.now
        word = t.value.lower()
        method = getattr(self, f"pipe_{_ALIASES.get(word, word)}", None)
        following = self.peek()
        if method is None or following.kind == "sym" and following.value == ":":
            if word in _STATS and following.value == "(":
                return self.pipe_stats()
            return Pipe("filter", {"filter": self.filter()})
        self.take()
        return method()

    def pipe_fields(self) -> Pipe:
        return Pipe("fields", {"all": True}) if self.accept("*") else Pipe("fields", {"fields": self.some_names()})

    def some_names(self) -> tuple[str, ...]:
        found = self.names()
        if not found:
            raise self.error("expected field names")
        return found

    def pipe_delete(self) -> Pipe:
        return Pipe("delete", {"fields": self.some_names()})

    def pairs(self) -> tuple[tuple[str, str], ...]:
        out = []
        while True:
            a = self.name()
            self.accept("as")
            out.append((a, self.name()))
            if not self.accept(","):
                return tuple(out)

    def pipe_copy(self) -> Pipe:
        return Pipe("copy", {"pairs": self.pairs()})

    def pipe_rename(self) -> Pipe:
        return Pipe("rename", {"pairs": self.pairs()})

    def pipe_filter(self) -> Pipe:
        return Pipe("filter", {"filter": self.filter()})

    def replacement(self) -> dict:
        self.expect("(")
        old = self.value()
        self.expect(",")
        new = self.value()
        self.expect(")")
        field = self.name() if self.accept("at") else "_msg"
        limit = self.number() if self.accept("limit") else 0
        return {"old": old, "new": new, "field": field, "limit": limit}

    def pipe_replace(self) -> Pipe:
        return Pipe("replace", self.replacement())

    def pipe_replace_regexp(self) -> Pipe:
        args = self.replacement()
        checked_regexp(args["old"])
        return Pipe("replace_regexp", args)

    def pipe_format(self) -> Pipe:
        template = self.value()
        self.accept("as")
        return Pipe("format", {"template": template, "name": self.name() if self.now.kind in ("word", "text") else "_msg"})

    def pipe_math(self) -> Pipe:
        out = []
        while True:
            expr = self.sum()
            self.accept("as")
            out.append((expr, self.name()))
            if not self.accept(","):
                return Pipe("math", {"items": tuple(out)})

    def sum(self):
        left = self.product()
        while True:
            if self.is_sym("+"):
                self.take()
                left = ("+", left, self.product())
            elif self.now.kind == "word" and self.now.value == "-":
                self.take()
                left = ("-", left, self.product())
            else:
                return left

    def product(self):
        left = self.power()
        while self.is_sym("*", "/", "%"):
            sign = self.take().value
            left = (sign, left, self.power())
        return left

    def power(self):
        left = self.operand()
        if self.accept("^"):
            return ("^", left, self.power())
        return left

    def operand(self):
        if self.accept("("):
            inside = self.sum()
            self.expect(")")
            return inside
        if self.now.kind == "word" and self.peek().value == "(" and self.now.value in ("abs", "ceil", "floor", "round", "exp", "ln", "max", "min"):
            func = self.take().value
            self.expect("(")
            args = [self.sum()]
            while self.accept(","):
                args.append(self.sum())
            self.expect(")")
            return (func, *args)
        if self.now.kind == "word" and re.fullmatch(r"-?\d+(\.\d+)?([eE][-+]?\d+)?", self.now.value):
            return ("number", float(self.take().value))
        return ("field", self.name())

    def pipe_len(self) -> Pipe:
        self.expect("(")
        field = self.name()
        self.expect(")")
        self.accept("as")
        return Pipe("len", {"field": field, "name": self.name()})

    def pipe_unpack_json(self) -> Pipe:
        self.accept("from")
        field = self.name() if self.now.kind in ("word", "text") and not self.is_word("fields", "result_prefix") else "_msg"
        fields = self.names() if self.accept("fields") else ()
        prefix = self.value() if self.accept("result_prefix") else ""
        return Pipe("unpack_json", {"field": field, "fields": fields, "prefix": prefix})

    def pipe_extract(self) -> Pipe:
        pattern = self.value()
        return Pipe("extract", {"pattern": pattern, "field": self.name() if self.accept("from") else "_msg"})

    def pipe_drop_empty_fields(self) -> Pipe:
        return Pipe("drop_empty_fields")

    def pipe_unroll(self) -> Pipe:
        self.accept("by")
        return Pipe("unroll", {"fields": self.some_names()})

    def pipe_block_stats(self) -> Pipe:
        raise QueryError("block_stats shows a storage engine's blocks, which do not exist here")

    def pipe_stats(self) -> Pipe:
        by: list[tuple[str, str]] = []
        if self.accept("by") or self.is_sym("("):
            self.expect("(")
            while not self.is_sym(")"):
                name, step = self.name(), ""
                if self.accept(":"):
                    step = self.value()
                by.append((name, step))
                if not self.accept(","):
                    break
            self.expect(")")
        out = []
        while True:
            func = self.take().value.lower()
            if func not in _STATS:
                raise self.error(f"unknown statistic {func!r}")
            self.expect("(")
            args = []
            while not self.is_sym(")"):
                args.append("*" if self.accept("*") else self.name())
                if not self.accept(","):
                    break
            self.expect(")")
            condition = None
            if self.accept("if"):
                self.expect("(")
                condition = self.filter()
                self.expect(")")
            self.accept("as")
            name = self.name() if self.now.kind in ("word", "text") else f"{func}({', '.join(args) or '*'})"
            out.append(Aggregate(func, tuple(args), name, condition))
            if not self.accept(","):
                return Pipe("stats", {"by": tuple(by), "items": tuple(out)})

    def order(self) -> tuple[tuple[str, bool], ...]:
        """(field, descending) in parentheses."""
        out = []
        self.expect("(")
        while not self.is_sym(")"):
            name = self.name()
            out.append((name, bool(self.accept("desc")) or (self.accept("asc") and False)))
            if not self.accept(","):
                break
        self.expect(")")
        return tuple(out)

    def pipe_sort(self) -> Pipe:
        self.accept("by")
        keys = self.order()
        if self.accept("desc"):
            keys = tuple((k, not d) for k, d in keys)
        args = {"keys": keys}
        while self.is_word("limit", "offset"):
            word = self.take().value.lower()
            args[word] = self.number()
        return Pipe("sort", args)

    def ranked(self, name: str) -> Pipe:
        n = self.number() if self.now.kind == "word" and self.now.value.isdigit() else 1
        keys = self.order() if self.accept("by") or self.is_sym("(") else (("_time", False),)
        part = ()
        if self.accept("partition"):
            self.expect("by")
            part = self.some_names()
        return Pipe(name, {"n": n, "keys": keys, "partition": part})

    def pipe_first(self) -> Pipe:
        return self.ranked("first")

    def pipe_last(self) -> Pipe:
        return self.ranked("last")

    def pipe_limit(self) -> Pipe:
        return Pipe("limit", {"n": self.number()})

    def pipe_offset(self) -> Pipe:
        return Pipe("offset", {"n": self.number()})

    def pipe_uniq(self) -> Pipe:
        self.accept("by")
        fields = self.some_names()
        hits = False
        if self.accept("with"):
            self.expect("hits")
            hits = True
        return Pipe("uniq", {"fields": fields, "hits": hits, "limit": self.number() if self.accept("limit") else None})

    def pipe_top(self) -> Pipe:
        n = self.number() if self.now.kind == "word" and self.now.value.isdigit() else 10
        self.accept("by")
        return Pipe("top", {"n": n, "fields": self.some_names()})

    def pipe_facets(self) -> Pipe:
        return Pipe("facets", {"n": self.number() if self.now.kind == "word" and self.now.value.isdigit() else 10})

    def pipe_field_names(self) -> Pipe:
        return Pipe("field_names")

    def pipe_field_values(self) -> Pipe:
        return Pipe("field_values", {"field": self.name(), "limit": self.number() if self.accept("limit") else None})

    def pipe_join(self) -> Pipe:
        self.accept("by")
        self.expect("(")
        on = self.names()
        self.expect(")")
        self.expect("(")
        query = self.pipeline()
        self.expect(")")
        return Pipe("join", {"on": on, "query": query, "how": "inner" if self.accept("inner") else "left", "prefix": self.value() if self.accept("prefix") else ""})

    def pipe_union(self) -> Pipe:
        self.expect("(")
        query = self.pipeline()
        self.expect(")")
        return Pipe("union", {"query": query})


_ALIASES = {"keep": "fields", "rm": "delete", "drop": "delete", "del": "delete", "cp": "copy", "mv": "rename", "where": "filter", "eval": "math", "order": "sort", "head": "limit", "skip": "offset"}


def parse(text: str) -> Query:
    """The syntax tree of a query."""
    if not text or not text.strip():
        raise QueryError("the query is empty")
    try:
        return Parser(text).query()
    except QueryError:
        raise
    except ValueError as e:
        raise QueryError(str(e)) from e
