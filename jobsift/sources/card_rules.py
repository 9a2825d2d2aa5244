"""Where each board keeps the fields of a posting card.

FIXED VALUES: the element names, attributes and patterns below are the boards'
own markup and must stay as they are for the fields to be found. A board is
one record; ``html_cards`` has the one engine that reads them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.html import Sel


@dataclass(frozen=True)
class Field:
    """A raw field: from the first kind in ``at`` that occurs (none: the scope
    element itself) take its text, an attribute (``@name``) or whether it is
    there (``?``)."""

    at: tuple[Sel, ...] = ()
    take: str = "text"
    sep: str = ""
    scope: str = "box"  # box, own (the element that marks the card) or part
    lower: bool = False
    markup: bool = False  # the text is itself HTML
    const: str | None = None


@dataclass(frozen=True)
class Box:
    """The card around the marking element: the nearest ancestor that holds
    ``holding`` or has more than ``longer`` characters of text, at most
    ``steps`` ancestors above the parent."""

    steps: int
    holding: Sel | None = None
    longer: int | None = None


@dataclass(frozen=True)
class Cards:
    mark: Sel
    fields: dict[str, Field]
    needs: tuple[Sel, ...] = ()  # kinds that must occur in the card
    filled: tuple[str, ...] = ()  # fields that must not be empty
    box: Box | None = None
    part: Sel | None = None  # an inner element that fields may refer to
    once: str | None = None  # a pattern of the href whose group occurs once on a page


def kind(*tags: str, cls: str | None = None, href: str | None = None, data_id: str | None = None,
         data_test: str | None = None, slot: str | None = None, subslot: str | None = None,
         cls_is: str | None = None) -> Sel:
    for attr, value, like in (("class", cls_is, cls), ("href", None, href), ("data-id", data_id, None),
                              ("data-test", None, data_test), ("slot", slot, None), ("data-subslot", subslot, None)):
        if value is not None or like is not None:
            return Sel(tags, attr, value, like)
    return Sel(tags)


TIME = kind("time")

CARDS = {
    "linkedin": Cards(
        mark=kind("li"),
        needs=(kind("a", href="/jobs/view/"),),
        fields={
            "href": Field((kind("a", href="/jobs/view/"),), "@href"),
            "title": Field((kind("h3", cls="title"),)),
            "company": Field((kind("h4", cls="company"), kind("h4", cls="subtitle"), kind("a", href="/company/"))),
            "description": Field(sep=" "),
            "card_text": Field(sep=" "),
            "has_time": Field((TIME,), "?"),
            "dt_attr": Field((TIME,), "@datetime"),
            "time_text": Field((TIME,)),
        }),
    "wellfound": Cards(
        mark=kind("div", data_test="job"),
        needs=(kind("h2", "h3", "a"), kind("a", href="/jobs/")),
        fields={
            "href": Field((kind("a", href="/jobs/"),), "@href"),
            "title": Field((kind("h2", "h3", "a"),)),
            "company": Field((kind(cls="(?i)company"),)),
            "description": Field(sep=" "),
            "time_text": Field((TIME, kind(cls="(?i)posted|date|ago"))),
        }),
    "builtin": Cards(
        mark=kind("a", "div", data_id="job-card-title"),
        filled=("href",),
        box=Box(steps=5, holding=kind(data_id="company-title")),
        fields={
            "href": Field(take="@href", scope="own"),
            "title": Field(scope="own"),
            "company": Field((kind(data_id="company-title"),)),
            "time_text": Field((kind(
                "span", cls_is="fs-xs fw-bold bg-gray-01 font-Montserrat text-gray-03 rounded-1 py-xs px-sm"),)),
            "description": Field((kind(cls="(?i)desc|summary"),), sep=" "),
        }),
    "roberthalf": Cards(
        mark=kind("rhcl-job-card"),
        needs=(kind("a", slot="headline"), kind("ul", slot="job-info")),
        filled=("href",),
        part=kind("ul", slot="job-info"),
        fields={
            "href": Field((kind("a", slot="headline"),), "@href"),
            "title": Field((kind("a", slot="headline"),)),
            "job_id": Field(take="@job-id"),
            "company": Field(const="Robert Half"),
            "location": Field((kind(subslot="location"),), scope="part"),
            "worksite": Field((kind(subslot="worksite"),), scope="part", lower=True),
            "type_raw": Field((kind(subslot="type"),), scope="part", lower=True),
            "description": Field((kind(subslot="copy"),), scope="part", sep=" ", markup=True),
            "date_text": Field((kind(subslot="date"),), scope="part"),
            "salary_min": Field((kind(subslot="salary-min"),), scope="part"),
            "salary_max": Field((kind(subslot="salary-max"),), scope="part"),
            "salary_currency": Field((kind(subslot="salary-currency"),), scope="part"),
            "salary_period": Field((kind(subslot="salary-period"),), scope="part"),
        }),
    "workatastartup": Cards(
        mark=kind("a", href=r"/jobs/\d+"),
        once=r"/jobs/(\d+)",
        filled=("title",),
        box=Box(steps=10, longer=80),
        fields={
            "href": Field(take="@href", scope="own"),
            "title": Field(scope="own"),
            "company": Field((kind("a", href="/company/"),)),
            "card_text": Field(sep=" "),
            "loc_el": Field((kind(cls="(?i)locat|city|region|where"),)),
            "has_time": Field((TIME,), "?"),
            "dt_attr": Field((TIME,), "@datetime"),
            "time_text": Field((TIME,)),
            "date_text": Field((kind(cls="(?i)date|posted|ago|time"),)),
        }),
}

#: Boards whose pages carry structured data that counts where no card is.
STRUCTURED_BOARDS = ("wellfound",)
STRUCTURED_TYPE = "application/ld+json"
