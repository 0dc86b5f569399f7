"""Small expressions of the document model: states, styles, labels, page maths, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States of a parse with progress in percent and shown text.
PARSE_STATES = {
    "Idle": (0, "Ready"),
    "Submitting": (10, "Uploading document..."),
    "Queued": (15, "Waiting in queue..."),
    "Processing": (35, "AI parsing in progress..."),
    "Downloading": (70, "Downloading results..."),
    "Caching": (80, "Caching results..."),
    "ParsingResult": (85, "Building document structure..."),
    "Completed": (100, "Parse completed"),
    "Failed": (-1, "Parse failed"),
}
#: States of a task.
RUNNING = ("pending", "running", "processing")
#: Colours of block types, and colour keys of their labels.
COLOURS = {"title": "Blue", "text": "Green", "image": "Orange", "table": "Purple", "caption": "Gray"}
COLOUR_KEYS = {"text": "Blue", "paragraph": "Blue", "title": "Purple", "heading": "Purple", "image": "Green", "figure": "Green", "table": "Orange", "caption": "Gray"}
#: Text rendering modes that stroke and that fill.
STROKES = ("Stroke", "StrokeClip", "FillThenStroke", "FillThenStrokeClip")
FILLS = ("Fill", "FillClip", "FillThenStroke", "FillThenStrokeClip")
#: Annotation flags.
NO_ZOOM, NO_ROTATE = 8, 16
#: Content operators that bear on text: glyph widths, compatibility, state, text, forms, marked content.
TEXT_OPERATORS = ("d0", "d1", "BX", "EX", "cm", "Q", "q", "gs", "BT", "ET", "Tc", "Tf", "Tz", "TL", "Tr", "Ts", "Tw", "Do", "T*", "'", "TD", "Td", '"', "Tm", "Tj", "TJ", "BMC", "BDC", "MP", "DP", "EMC")
#: The share of a word's width that its letters' widths may sum up to.
CONSISTENT = (0.8, 1.2)
#: Printer orientations and scalings.
ORIENTATIONS = {"Portrait": 3, "Landscape": 4}
SCALINGS = {"FitToPage": "fit", "ActualSize": "none", "ShrinkToFit": "auto-fit", "CustomScale": "none"}


def looked_up(table: dict, key: Column, default) -> Column:
    listed = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(listed, key), F.lit(default))


def progress(state: Column) -> Column:
    return looked_up({k: v[0] for k, v in PARSE_STATES.items()}, state, 0)


def state_shown(state: Column) -> Column:
    return looked_up({k: v[1] for k, v in PARSE_STATES.items()}, state, "Unknown")


def is_terminal(state: Column) -> Column:
    return state.isin("Completed", "Failed")


def task_class(status: Column) -> Column:
    return F.when(status.isin(*RUNNING), "running").when(status.isin("completed", "failed"), status).otherwise("other")


def percent_done(done: Column, total: Column) -> Column:
    """Whole percent, rounded up; null without a total."""
    return F.ceil(F.when(total > 0, done) / F.when(total > 0, total) * 100).cast("int")


def stages_shown(has: dict[str, Column], none: str) -> Column:
    """The names of the stages that are there, joined; ``none`` if there is none."""
    parts = F.array_compact(F.array(*[F.when(there, F.lit(name)) for name, there in has.items()]))
    return F.when(F.size(parts) > 0, F.array_join(parts, " | ")).otherwise(none)


def colour(kind: Column) -> Column:
    return looked_up(COLOURS, kind, "LightGray")


def colour_key(label: Column) -> Column:
    return looked_up(COLOUR_KEYS, F.lower(label), "Default")


def preview(text: Column, most: int, empty: Column) -> Column:
    """The first ``most`` characters and dots; ``empty`` for none."""
    return F.when(F.coalesce(text, F.lit("")) == "", empty).when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def block_label(kind: Column, source: Column) -> Column:
    kept = lambda c, when: F.when((F.coalesce(c, F.lit("")) != "") & when, c)
    return F.concat_ws(" / ", kept(kind, F.lit(True)), kept(source, F.coalesce(source != kind, F.lit(True))))


def toggled(members: Column, member: Column) -> Column:
    """A set as an array, with ``member`` taken out if it is in, else put at the end."""
    return F.when(F.array_contains(members, member), F.array_remove(members, member)).otherwise(F.array_append(members, member))


def page_selected(page: Column, first: Column, last: Column) -> Column:
    return page.between(F.least(first, last), F.greatest(first, last))


def scaled(size: Column, ppi: Column) -> Column:
    return size * ppi


def relative_offset(scroll: Column, scale: Column, top: Column) -> Column:
    return F.greatest(F.lit(0.0), scroll / scale - top)


def turned_view(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, rotation: Column) -> Column:
    """A view (x, y, w, h) on a page as the unturned page sees it."""
    def box(*at: Column) -> Column:
        return F.struct(*[c.cast("double").alias(n) for c, n in zip(at, ("x", "y", "w", "h"), strict=True)])

    return F.when(rotation == 90, box(y, page_w - (x + w), h, w)).when(rotation == 180, box(page_w - (x + w), page_h - (y + h), w, h)).when(rotation == 270, box(page_h - (y + h), x, h, w)).otherwise(box(x, y, w, h))


def print_orientation(asked: Column, landscape: Column) -> Column:
    """The printer's number of an orientation; null to leave it to the printer."""
    return F.when(asked == "Portrait", ORIENTATIONS["Portrait"]).when((asked == "Landscape") & landscape, ORIENTATIONS["Landscape"])


def print_colour(mono: Column, supported: Column) -> Column:
    return F.when(mono & supported, "monochrome")


def pages_per_sheet(asked: Column, supported: Column) -> Column:
    return F.when(F.array_contains(supported, asked), asked).otherwise(1)


def print_scaling(mode: Column) -> Column:
    return looked_up(SCALINGS, mode, "fit")


def has_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(F.lit(flag)) != 0


def clean_append(parts: Column) -> Column:
    """Pieces put together, NULs as blanks, blank pieces left out."""
    plain = F.transform(parts, lambda p: F.translate(p, "\0", " "))
    return F.array_join(F.filter(plain, lambda p: F.coalesce(~p.rlike(r"^\s*$"), F.lit(False))), "")


def is_valid_path(path: Column) -> Column:
    """No control character or bar in the folder, and none of the characters that names can't have in the name."""
    name = F.substring_index(path, "/", -1)
    return ~F.substring(path, F.lit(1), F.length(path) - F.length(name)).rlike(r"[\x00-\x1f|]") & ~name.rlike(r'[\x00-\x1f"<>|:*?\\]')


def source_order(source_id: Column) -> Column:
    """The number behind the first colon of "doc:order"; null without one."""
    return F.when(source_id.contains(":"), F.get(F.split(source_id, ":"), F.lit(1))).try_cast("int")


def page_sizes(sizes: Column) -> Column:
    """A map of page number to (width, height) from one of text to numbers; bad keys and short values are left out."""
    good = F.map_filter(sizes, lambda k, v: k.try_cast("int").isNotNull() & (F.size(v) >= 2))
    return F.transform_values(F.transform_keys(good, lambda k, _: k.cast("int")), lambda _, v: F.named_struct(F.lit("w"), v[0], F.lit("h"), v[1]))


def bbox_to_array(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(x, y, x + w, y + h)


def colour_space(numbers: Column) -> Column:
    """What the number of an annotation's colour components says."""
    return F.when(F.size(numbers) == 1, "gray").when(F.size(numbers) == 3, "rgb").when(F.size(numbers) == 4, "cmyk")


def letter_over(position: Column, ends: Column) -> Column:
    """The first letter that ends (``ends``: ascending shares of the word's width, the last left out) at or after a place; else the last."""
    found = F.filter(F.transform(ends, lambda e, i: F.when(position <= e, i)), lambda i: i.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.size(ends))


def nearest_letter(position: Column, ends: Column) -> Column:
    """The letter whose end is nearest to a place; the first of equals. The last letter ends at 1."""
    far = F.transform(F.concat(ends, F.array(F.lit(1.0))), lambda e, i: F.struct(F.abs(position - e).alias("d"), i.alias("i")))
    return F.array_min(far)["i"]


def part_of_word(value: Column, starts: Column, first: Column, last: Column) -> Column:
    """Characters of letters ``first`` to ``last``; ``starts``: where each letter's text begins, from 0, and the length at the end."""
    begin, end = F.get(starts, first), F.get(starts, last + 1)
    return F.substring(value, begin + 1, end - begin)


def without_soft_hyphens(text: Column) -> Column:
    return F.replace(text, F.lit("­"), F.lit(""))


def bears_on_text(operator: Column) -> Column:
    """Whether a content operator can change what text a page shows and where."""
    return operator.isin(*TEXT_OPERATORS)


def consistent_widths(widths: Column, width: Column) -> Column:
    """Whether letters' widths sum up to about their word's; false without letters or width."""
    total = F.aggregate(widths, F.lit(0.0), lambda a, w: a + w)
    return F.coalesce((width > 0) & (F.size(widths) > 0) & (total / F.when(width > 0, width)).between(*CONSISTENT), F.lit(False))


def other_values(known: Column) -> Column:
    """A document's further properties: the entries of a map that have a value."""
    return F.map_filter(known, lambda _, v: v.isNotNull())
