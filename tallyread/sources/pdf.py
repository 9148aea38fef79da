"""A writer of minimal PDFs, an engine that reads at least those, and other engines."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class PlacedWord:
    word: str
    x: float
    y: float


def _number(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else str(value)


def pdf_with_pages(pages: Sequence[Sequence[PlacedWord]]) -> str:
    """A real PDF of some pages of words, pure ASCII; words are not escaped."""
    bodies: list[str] = [
        "<< /Type /Catalog /Pages 2 0 R >>",
        "",
        "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    ]
    kids = []
    for words in pages:
        drawn = "\n".join(f"BT /F1 10 Tf {_number(w.x)} {_number(w.y)} Td ({w.word}) Tj ET" for w in words)
        number = len(bodies) + 1
        kids.append(f"{number} 0 R")
        bodies.append(
            "<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] "
            f"/Resources << /Font << /F1 3 0 R >> >> /Contents {number + 1} 0 R >>"
        )
        bodies.append(f"<< /Length {len(drawn)} >>\nstream\n{drawn}\nendstream")
    bodies[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>"
    out, places = "%PDF-1.4\n", []
    for number, body in enumerate(bodies, 1):
        places.append(len(out))
        out += f"{number} 0 obj\n{body}\nendobj\n"
    table = "".join(f"{place:010d} 00000 n \n" for place in places)
    return (
        f"{out}xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n{table}"
        f"trailer\n<< /Size {len(bodies) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n"
    )


def pdf_with_text(words: Sequence[PlacedWord]) -> str:
    """The same with one page."""
    return pdf_with_pages([words])


class PlainPdfEngine:
    """Reads PDFs whose streams are not compressed and whose text is placed by Td."""

    _OBJECT = re.compile(rb"(\d+) 0 obj\s(.*?)\sendobj", re.S)
    _WORD = re.compile(r"BT\s+/\S+\s+([\d.]+)\s+Tf\s+(-?[\d.]+)\s+(-?[\d.]+)\s+Td\s+\((.*?)\)\s+Tj\s+ET", re.S)

    def open(self, data: bytes) -> tuple[int, Iterable[tuple[float, float, list]]]:
        if not data.startswith(b"%PDF-") or b"/Encrypt" in data:
            raise ValueError("not a PDF that this engine reads")
        objects = {int(m[1]): m[2] for m in self._OBJECT.finditer(data)}
        kids = next((o for o in objects.values() if b"/Type /Pages" in o), None)
        if kids is None:
            raise ValueError("no pages")
        listed = re.search(rb"/Kids\s*\[(.*?)\]", kids, re.S)
        numbers = [int(n) for n in re.findall(rb"(\d+) 0 R", listed[1] if listed else b"")]
        return len(numbers), (self._page(objects, objects[n]) for n in numbers)

    def _page(self, objects: dict[int, bytes], page: bytes) -> tuple[float, float, list]:
        box = [float(x) for x in re.search(rb"/MediaBox\s*\[([^\]]*)\]", page)[1].split()]
        content = objects[int(re.search(rb"/Contents (\d+) 0 R", page)[1])]
        stream = content.split(b"stream\n", 1)[1].rsplit(b"\nendstream", 1)[0].decode("latin-1")
        items = [
            {
                "str": m[4],
                "transform": [float(m[1]), 0, 0, float(m[1]), float(m[2]), float(m[3])],
                "width": 0.5 * float(m[1]) * len(m[4]),
            }
            for m in self._WORD.finditer(stream)
        ]
        return box[2] - box[0], box[3] - box[1], items


class _Pypdf:
    """The pypdf library, if it is installed."""

    def open(self, data: bytes):
        import io

        import pypdf

        pdf = pypdf.PdfReader(io.BytesIO(data))

        def pages():
            for page in pdf.pages:
                items: list[dict] = []

                def visit(text, _cm, tm, _font, size):
                    items.append({"str": text, "transform": list(tm), "width": 0.5 * (size or 0) * len(text)})

                page.extract_text(visitor_text=visit)
                yield float(page.mediabox.width), float(page.mediabox.height), items

        return len(pdf.pages), pages()


class _Pypdfium:
    """The pypdfium2 library, if it is installed."""

    def open(self, data: bytes):
        import pypdfium2

        pdf = pypdfium2.PdfDocument(data)

        def pages():
            for page in pdf:
                text = page.get_textpage()
                items = []
                for i in range(text.count_rects()):
                    left, bottom, right, top = text.get_rect(i)
                    items.append(
                        {"str": text.get_text_bounded(left, bottom, right, top), "transform": [1, 0, 0, 1, left, bottom], "width": right - left}
                    )
                yield (*page.get_size(), items)

        return len(pdf), pages()


def engine_for(name: str):
    return {"pypdf": _Pypdf, "pypdfium2": _Pypdfium}[name]()
