"""The step grammar: an ordered list of presence markers, input variants, transforms, validators and scopes of a field.

    required trim minlen=2 oneof=a|b|'c d'
    nullzero / . / @ToInt ~ gte=0
    minlen=1 inner:(trim notempty) keys:(tolower minrunes=2)
    @is_even:'must be even'
"""

from __future__ import annotations

from dataclasses import dataclass, field


class StepError(ValueError):
    """A step list that can't be read or doesn't fit its field."""


@dataclass(frozen=True)
class Step:
    name: str
    args: tuple[str, ...] = ()
    function: bool = False
    message: str | None = None

    @property
    def arg(self) -> str:
        return "|".join(self.args)


@dataclass
class Pipe:
    steps: list[Step] = field(default_factory=list)
    variants: list[Step] = field(default_factory=list)
    inner: Pipe | None = None
    keys: Pipe | None = None

    @property
    def required(self) -> bool:
        return any(s.name == "required" for s in self.steps)

    @property
    def null_zero(self) -> bool:
        return any(v.name == "nullzero" for v in self.variants) or any(s.name == "nullzero" for s in self.steps)


def _tokens(text: str) -> list[str]:
    """Words at depth 0: quotes keep spaces, parentheses nest."""
    out, own, depth, quoted, escaped = [], "", 0, False, False
    for c in text:
        if escaped or quoted and c == "\\":
            own, escaped = own + c, not escaped
            continue
        if c == "'":
            quoted = not quoted
        if not quoted:
            depth += (c == "(") - (c == ")")
            if depth < 0:
                raise StepError(f"unbalanced ')' in {text!r}")
            if c.isspace() and not depth:
                if own:
                    out.append(own)
                own = ""
                continue
            if c in "~/" and not depth and (c == "~" or _variant(own)) and "=" not in own:
                out += [own, c] if own else [c]
                own = ""
                continue
        own += c
    if quoted or depth:
        raise StepError(f"unclosed {'quote' if quoted else 'parenthesis'} in {text!r}")
    return [*out, own] if own else out


def _variant(own: str) -> bool:
    """What stands before a `/` that separates variants."""
    return own in ("", ".", "nullzero") or own[0] == "@" and ":" not in own


def _parts(text: str) -> tuple[str, ...]:
    out, own, quoted, escaped = [], "", False, False
    for c in text:
        if escaped or quoted and c == "\\":
            own, escaped = own + c * escaped, not escaped
        elif c == "'":
            quoted = not quoted
        elif c == "|" and not quoted:
            out.append(own)
            own = ""
        else:
            own += c
    return (*out, own)


def _step(token: str) -> Step:
    if token.startswith("@"):
        name, _, message = token[1:].partition(":")
        if not name:
            raise StepError("'@' needs a function's name")
        return Step(name, function=True, message=_parts(message)[0] or None)
    name, eq, value = token.partition("=")
    if not name:
        raise StepError(f"a step without a name: {token!r}")
    return Step(name, _parts(value) if eq else ())


def parse(text: str) -> Pipe:
    tokens = _tokens(text)
    pipe = Pipe()
    if "~" in tokens or "/" in tokens:
        at = tokens.index("~") if "~" in tokens else len(tokens)
        head, tokens = tokens[:at], tokens[at + 1 :]
        if len(head) % 2 == 0 or any(t != "/" for t in head[1::2]):
            raise StepError(f"variants must be separated by '/': {text!r}")
        pipe.variants = [_step(t) for t in head[::2]]
    elif tokens and tokens[0] == "nullzero":
        pipe.variants, tokens = [Step("nullzero"), Step(".")], tokens[1:]
    for t in tokens:
        if t == "~":  # stages follow each other as steps do
            continue
        scope, colon, body = t.partition(":")
        if colon and scope in ("inner", "keys"):
            if getattr(pipe, scope):
                raise StepError(f"{scope} given twice in {text!r}")
            setattr(pipe, scope, parse(body[1:-1] if body.startswith("(") and body.endswith(")") else body))
        else:
            pipe.steps.append(_step(t))
    return pipe
