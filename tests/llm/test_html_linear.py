"""Broken and hostile pages: parsed in time that grows as their length, with the blocks that a reader would see."""

import time

import numpy as np
import pytest

from prematch.llm import html_extract
from prematch.llm.html_dom import Dom

MB = 1 << 20
HOSTILE = {
    "open tags with a quote": "<a '", "open tags": "<a ", "quotes that never close": '<b x="y\'', "nested elements": "<div>", "end tags in a script": "</script", "declarations": "<!", "less-than signs": "<",
    "cells in cells": "<table><tr><td><p>", "lists in lists": "<ul><li>", "comments": "<!--", "names of characters": "&amp", "raw elements": "<svg>x", "quotes that close each other": "\"><b y='",
}


@pytest.mark.parametrize("name", HOSTILE)
@pytest.mark.parametrize("end", ["", ">", "'>"])
def test_time_grows_as_the_page(name, end):
    part = HOSTILE[name]
    seconds = []
    for size in (MB // 8, MB // 2):
        page = ("<script>" if name == "end tags in a script" else "<p>") + part * (size // len(part)) + end
        start = time.process_time()
        Dom(page).statistics()
        seconds.append(time.process_time() - start)
    assert seconds[1] < max(8 * seconds[0], 1.0)  # 4 times the page; a quadratic parser takes 16 times as long


@pytest.mark.parametrize("page, blocks", [
    ("<p>one <b>two</b><p>three", ["one two", "three"]),
    ("a < b and c > d", ["a < b and c > d"]),
    ("x <a href='q>r' title=\"<p>\">y</a> z", ["x y z"]),
    ("a<!-- <p>b</p> -->c<!-- open", ["ac"]),
    ("<?xml x?><!DOCTYPE html>t", ["t"]),
    ("t<script>if (a<b) '</p>'</script >u<style>p{}", ["tu"]),
    ("<p>done<p class='x", ["done"]),
    ("<p>quote <a title=\"never closes>kept</a>", ["quote <a title=\"never closes>kept"]),
    ("&lt;p&gt; &eacute;&#233;&#xe9; &#" + "9" * 6000 + ";", ["<p> ééé �"]),
    ("<div><p>a<td>b<div>c</div></td></div>d", ["a", "b", "c", "d"]),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]),
])
def test_blocks(page, blocks):
    assert [line for _, line in Dom(page).blocks] == blocks


def test_end_of_an_outer_element_closes_the_inner_ones():
    dom = Dom("<div><section><p>a</div><p>b")
    assert [(dom.tag[e], dom.depth[e]) for e, _ in dom.blocks] == [("p", 3), ("p", 1)]


def test_headings_stay_on_pages_without_landmarks():
    dom = Dom("<html><body><h1>t</h1><p>a</p><h2>u</h2><p>b</p><h3>last</h3></body></html>")
    keep = np.array([True, True, True, False, True, False, True, False])
    assert html_extract.with_headings(dom, keep).tolist() == [True] * 7 + [False]
    marked = Dom("<html><body><article><h1>t</h1><p>a</p></article></body></html>")
    keep = np.array([True, True, True, True, False, True])
    assert html_extract.with_headings(marked, keep).tolist() == keep.tolist()
