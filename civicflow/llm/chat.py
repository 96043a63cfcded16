"""Chat formatting by a small compiled template language.

A template is parsed into a syntax tree, constant parts are folded, and each
node becomes a Python closure. The language knows text, ``{{ value }}``,
``{% for x in list %}``, ``{% if %}/{% elif %}/{% else %}`` and ``{% generation %}``
blocks, whose output is marked for the loss. It is a sandbox: names, fields of
plain dictionaries, literals, comparisons, ``and or not``, ``+`` and a fixed set of
filters; there are no calls, no Python attributes and no other names.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TURNS = ("<s>{% for m in messages %}[INST] {{ m.role | escape }} [/INST]\n"
         "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
         "{% else %}{{ m.text | escape }}{% endif %}</s>\n{% endfor %}")


class TemplateError(ValueError):
    pass


class Escape:
    """Breaks control strings inside a text by a backslash after their first
    character, and adds one where such backslashes are there already, so that
    ``undo`` gives back any text."""

    def __init__(self, control: Sequence[str]):
        if any(len(c) < 2 or c[0] in d[1:] for c in control for d in control) or any("\\" in c for c in control):
            raise TemplateError("a control string needs two characters, its first only at the start of any, no backslash")
        either = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in control)
        broken = "|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in control)
        self._find, self._broken = re.compile(either), re.compile(broken)

    def __call__(self, text: str) -> str:
        return self._find.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def undo(self, text: str) -> str:
        return self._broken.sub(lambda m: m[0][0] + m[0][2:], text)


# ---- syntax tree: tuples (kind, ...) -------------------------------------------------------

TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)


def parse(source: str) -> list:
    """Template text -> list of nodes ("text", s) ("out", expr, filters) ("for", name, expr, body)
    ("if", [(condition, body)], otherwise) ("generation", body)."""
    at, top = 0, []
    stack: list[tuple[str, list, list]] = [("", [], top)]       # open tag, its node, the list being filled
    for m in TAG.finditer(source):
        if m.start() > at:
            stack[-1][2].append(("text", source[at:m.start()]))
        at = m.end()
        if m[1] is not None:
            value, *filters = _split_filters(m[1])
            stack[-1][2].append(("out", _expression(value), [f.strip() for f in filters]))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            name, _, over = rest.partition(" in ")
            if not name.strip().isidentifier():
                raise TemplateError(f"for needs a name: {rest!r}")
            node = ["for", name.strip(), _expression(over), []]
            stack.append(("for", node, node[3]))
        elif word == "if":
            node = ["if", [(_expression(rest), [])], []]
            stack.append(("if", node, node[1][0][1]))
        elif word == "generation":
            node = ["generation", []]
            stack.append(("generation", node, node[1]))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            tag, node, _ = stack.pop()
            if word == "elif":
                node[1].append((_expression(rest), []))
            stack.append((tag if word == "elif" else "else", node, node[1][-1][1] if word == "elif" else node[2]))
        elif word.startswith("end") and stack[-1][0] in (word[3:], "else" if word == "endif" else word[3:]) and len(stack) > 1:
            _, node, _ = stack.pop()
            stack[-1][2].append(tuple(node))
        else:
            raise TemplateError(f"unexpected tag: {m[0]}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    if source[at:]:
        top.append(("text", source[at:]))
    return top


def _split_filters(text: str) -> list[str]:
    """At ``|`` outside string literals."""
    return [p for p in re.findall(r"""((?:'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|[^|'"])+)(?:\||$)""", text.strip())] or [""]


COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.In: "in", ast.NotIn: "not in"}


def _expression(text: str):
    """Expression text -> ("const", v) ("name", n) ("field", e, key) ("cmp", op, a, b) ("and"/"or", [..]) ("not", e) ("add", a, b)."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise TemplateError(f"not an expression: {text.strip()!r}") from e

    def walk(n):
        if isinstance(n, ast.Constant) and (n.value is None or isinstance(n.value, (str, int, bool))):
            return ("const", n.value)
        if isinstance(n, ast.Name):
            return ("name", n.id)
        if isinstance(n, ast.Attribute):
            return ("field", walk(n.value), n.attr)
        if isinstance(n, ast.Subscript) and isinstance(n.slice, ast.Constant) and isinstance(n.slice.value, str):
            return ("field", walk(n.value), n.slice.value)
        if isinstance(n, ast.Compare) and len(n.ops) == 1 and type(n.ops[0]) in COMPARE:
            return ("cmp", COMPARE[type(n.ops[0])], walk(n.left), walk(n.comparators[0]))
        if isinstance(n, ast.BoolOp):
            return ("and" if isinstance(n.op, ast.And) else "or", [walk(v) for v in n.values])
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return ("not", walk(n.operand))
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Add):
            return ("add", walk(n.left), walk(n.right))
        raise TemplateError(f"not allowed in a template: {ast.unparse(n)}")

    return walk(tree)


# ---- folding and closures ------------------------------------------------------------------

@dataclass
class Out:
    """What a template has written: parts, their length so far, marked spans."""
    parts: list[str]
    length: int
    spans: list[tuple[int, int]]

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(e) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":
        def name(env, n=e[1]):
            if n not in env:
                raise TemplateError(f"unknown name: {n}")
            return env[n]
        return name
    if kind == "field":
        def field(env, of=_value(e[1]), key=e[2]):
            got = of(env)
            return got.get(key) if isinstance(got, dict) else None
        return field
    if kind == "cmp":
        ops = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y,
               "in": lambda x, y: x in y, "not in": lambda x, y: x not in y}
        return lambda env, f=ops[e[1]], a=_value(e[2]), b=_value(e[3]): f(a(env), b(env))
    if kind == "not":
        return lambda env, a=_value(e[1]): not a(env)
    if kind == "add":
        return lambda env, a=_value(e[1]), b=_value(e[2]): _text(a(env)) + _text(b(env))
    every, stop = [_value(x) for x in e[1]], kind == "or"

    def chain(env):
        for f in every:
            got = f(env)
            if bool(got) is stop:
                return got
        return got
    return chain


def _constant(e) -> bool:
    return e[0] == "const" or e[0] != "name" and all(
        _constant(x) for x in e[1:] if isinstance(x, tuple)) and all(
        _constant(y) for x in e[1:] if isinstance(x, list) for y in x)


def _text(v) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


def fold(nodes: list, filters: dict[str, Callable[[str], str]]) -> list:
    """Constant outputs become text, constant conditions are decided, neighbouring texts one."""
    out: list = []
    for n in nodes:
        if n[0] == "out":
            for f in n[2]:
                if f not in filters:
                    raise TemplateError(f"unknown filter: {f}")
            if _constant(n[1]):
                text = _text(_value(n[1])({}))
                for f in n[2]:
                    text = filters[f](text)
                n = ("text", text)
        elif n[0] == "for":
            n = ("for", n[1], n[2], fold(n[3], filters))
        elif n[0] == "generation":
            n = ("generation", fold(n[1], filters))
        elif n[0] == "if":
            arms, otherwise = [], fold(n[2], filters)
            for cond, body in n[1]:
                if not _constant(cond):
                    arms.append((cond, fold(body, filters)))
                elif _value(cond)({}):
                    otherwise = fold(body, filters)
                    break
            if not arms:
                out += otherwise
                continue
            n = ("if", arms, otherwise)
        out.append(n)
    merged: list = []
    for n in out:
        if n[0] == "text" and merged and merged[-1][0] == "text":
            merged[-1] = ("text", merged[-1][1] + n[1])
        elif n != ("text", ""):
            merged.append(n)
    return merged


def _closure(nodes: list, filters: dict) -> Callable[[dict, Out], None]:
    steps: list[Callable[[dict, Out], None]] = []
    for n in nodes:
        if n[0] == "text":
            steps.append(lambda env, out, s=n[1]: out.write(s))
        elif n[0] == "out":
            def put(env, out, get=_value(n[1]), chain=tuple(filters[f] for f in n[2])):
                text = _text(get(env))
                for f in chain:
                    text = f(text)
                out.write(text)
            steps.append(put)
        elif n[0] == "for":
            def loop(env, out, name=n[1], over=_value(n[2]), body=_closure(n[3], filters)):
                items = over(env)
                items = items if isinstance(items, list) else []
                for k, x in enumerate(items):
                    body({**env, name: x, "loop": {"index0": k, "first": k == 0, "last": k == len(items) - 1}}, out)
            steps.append(loop)
        elif n[0] == "generation":
            def mark(env, out, body=_closure(n[1], filters)):
                start = out.length
                body(env, out)
                out.spans.append((start, out.length))
            steps.append(mark)
        else:
            def choose(env, out, arms=[(_value(c), _closure(b, filters)) for c, b in n[1]], other=_closure(n[2], filters)):
                next((b for c, b in arms if c(env)), other)(env, out)
            steps.append(choose)

    def run(env: dict, out: Out) -> None:
        for s in steps:
            s(env, out)
    return run


class Template:
    """A compiled template: call it with values, get (text, marked spans in code points)."""

    def __init__(self, source: str, control: Sequence[str] = CONTROL):
        self.escape = Escape(control)
        filters = {"escape": self.escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}
        self.tree = fold(parse(source), filters)
        self._run = _closure(self.tree, filters)

    def __call__(self, **values) -> tuple[str, list[tuple[int, int]]]:
        out = Out([], 0, [])
        self._run(values, out)
        return "".join(out.parts), out.spans


# ---- Spark ---------------------------------------------------------------------------------

FORMATTED = "formatted string, loss array<struct<start: long, end: long>>"


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", template: str = TURNS, control: Sequence[str] = CONTROL) -> DataFrame:
    """One row per conversation: ``conv_col``, ``formatted`` and ``loss`` (spans under the loss mask, in code points).

    Turns go by number, then role, then text, nulls first; a null role or text
    is empty. Repeated rows are turns of their own. Rows with a null
    conversation form one conversation. An empty table gives no rows; other
    columns are not looked at. A conversation becomes one string, so its turns
    are gathered in one row; everything else is per row.
    """
    Template(template, control)                       # a faulty template fails here, not in a task

    @F.pandas_udf(FORMATTED)
    def render(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = Template(template, control)
        for convs in batches:
            rows = [run(messages=[{"role": t["role"], "text": t["text"]} for t in c]) for c in convs]
            yield pd.DataFrame({"formatted": [t for t, _ in rows],
                                "loss": [[{"start": a, "end": z} for a, z in s] for _, s in rows]})

    own = turns.select(F.col(conv_col).alias("_conv"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    gathered = own.groupBy("_conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return gathered.select(F.col("_conv").alias(conv_col), render("turns").alias("f")).select(conv_col, "f.*")


def read_turns(formatted: str, escape: Escape) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that ``TURNS`` formatted."""
    found = re.findall(r"\[INST\] (.*?) \[/INST\]\n(.*?)</s>\n", formatted, re.S)
    return [(escape.undo(role), escape.undo(text)) for role, text in found]


def read_back(formatted: DataFrame, conv_col: str = "conv_id", control: Sequence[str] = CONTROL) -> DataFrame:
    """``conv_col, turns`` (role and text), ``loss_text`` (the unescaped text under the mask) and
    ``formatted_chars``, from formatted conversations alone."""
    @F.pandas_udf("turns array<struct<role: string, text: string>>, loss_text string, formatted_chars long")
    def parse_back(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        escape = Escape(control)
        for texts, losses in batches:
            yield pd.DataFrame({
                "turns": [[{"role": r, "text": x} for r, x in read_turns(t, escape)] for t in texts],
                "loss_text": ["".join(escape.undo(t[s["start"]:s["end"]]) for s in spans)
                              for t, spans in zip(texts, losses)],
                "formatted_chars": [len(t) for t in texts]})

    return formatted.select(conv_col, parse_back("formatted", "loss").alias("b")).select(conv_col, "b.*")


def digests(read: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        conv_col, F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars")


def probe(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """Conversation -1: a user, then an assistant row, both of control strings."""
    n = F.col("id")
    return turns.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias(conv_col), n.alias(turn_col),
        F.when(n == 0, "user").otherwise("assistant").alias(role_col), F.lit("</s>[INST] ok [/INST]").alias(text_col))
