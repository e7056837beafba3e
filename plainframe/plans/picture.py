"""The rows of a drawing as a picture: a spine of steps, a chip for each column, other tables beside the step that reads them."""

from __future__ import annotations

from html import escape

from .ladder import Row

#: Widths of a letter of either size, and measures of the page, in pixels.
LETTER, SMALL, LINE, CHIP, GAP, LEFT, WIDE = 8, 6, 20, 24, 6, 40, 900

STYLE = (
    "text{font:13px ui-monospace,monospace;fill:#1f2430}.small{font-size:10px;fill:#667}.step{font-weight:600}.spine{stroke:#99a;stroke-width:2}"
    ".chip{fill:#eef1f6;stroke:#ccd}.new{fill:#dcf3e2;stroke:#7cb98f}.gone{fill:#fbe9e7;stroke:#d9a09a}.struck{text-decoration:line-through;fill:#966}"
    ".other{fill:none;stroke:#99a;stroke-dasharray:4 3}.refused{fill:#b3261e}"
)


class _Page:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.y, self.width = 16, 0

    def text(self, x: int, y: int, words: str, kind: str = "") -> None:
        small = kind == "small"
        self.width = max(self.width, x + len(words) * (SMALL if small else LETTER))
        self.parts.append(f'<text x="{x}" y="{y}"{f" class={chr(34)}{kind}{chr(34)}" if kind else ""}>{escape(words)}</text>')

    def folded(self, x: int, words: str, kind: str) -> None:
        line = ""
        for w in words.split(" "):
            if line and (len(line) + 1 + len(w)) * LETTER > WIDE - x:
                self.text(x, self.y, line, kind)
                self.y, line = self.y + LINE, ""
            line = f"{line} {w}" if line else w
        self.text(x, self.y, line, kind)
        self.y += LINE

    def chips(self, x: int, columns: list[tuple[str, str, str]]) -> None:
        """Name, kind of value and class of each; a line is folded where the page ends."""
        at = x
        for name, kind, look in columns:
            wide = len(name) * LETTER + (len(kind) * SMALL + 6 if kind else 0) + 14
            if at > x and at + wide > WIDE:
                at, self.y = x, self.y + CHIP + GAP
            self.parts.append(f'<rect x="{at}" y="{self.y - 12}" width="{wide}" height="{CHIP}" rx="5" class="{look}"/>')
            self.text(at + 7, self.y + 4, name, "struck" if look == "gone" else "")
            if kind:
                self.text(at + 13 + len(name) * LETTER, self.y + 4, kind, "small")
            at += wide + GAP
            self.width = max(self.width, at)
        self.y += CHIP + GAP


def svg(rows: list[Row]) -> str:
    page, knots = _Page(), []
    for k, r in enumerate(rows):
        knots.append(page.y - 4)
        page.folded(LEFT, r.label, "step")
        if r.refusal:
            for line in r.refusal.split("\n"):
                page.text(LEFT, page.y, line, "refused")
                page.y += LINE
            break
        if r.other:
            top, (name, columns) = page.y - 14, r.other
            page.text(LEFT + 30, page.y, name, "small")
            page.y += LINE
            page.chips(LEFT + 30, [(n, kind, "chip") for n, kind in columns])
            page.parts.append(f'<path d="M{LEFT + 22} {top} V{page.y - 16} M{LEFT + 22} {top + 6} H{LEFT - 14}" class="other"/>')
        page.chips(LEFT, [(n, "" if k else kind, "chip") for n, kind in r.kept] + [(n, kind, "new") for n, kind in r.new] + [(n, "", "gone") for n in r.gone])
        if r.note:
            page.text(LEFT, page.y - 4, r.note, "small")
            page.y += LINE - 4
        page.y += 8
    spine = f'<line x1="20" y1="{knots[0]}" x2="20" y2="{knots[-1]}" class="spine"/>' + "".join(f'<circle cx="20" cy="{y}" r="5" class="chip"/>' for y in knots)
    width, height = page.width + 20, page.y + 8
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}"><style>{STYLE}</style>{spine}{"".join(page.parts)}</svg>'
