from folioforge.sources.elements import ELEMENTS, map_elements


def element(i, label, text=None, layer="body", level=None, captions=None, footnotes=None, grid=None, prov=None, ref=None):
    return ("d", i, ref or f"#/{i}", layer, label, text, level, captions, footnotes, grid, prov)


def test_mapping(spark):
    box = (1.0, 9.0, 3.0, 5.0, "CoordOrigin.BOTTOMLEFT")
    rows = [
        element(0, "page_header", "chrome"), element(1, "title", " Report "), element(2, "section_header", "4.2 Cells", level=1), element(3, "section_header", "Odd", level=3), element(4, "document_index", grid=[]), element(5, "text", "____ —"),
        element(6, "text", "prose", prov=[(1, box), (2, None)]), element(7, "list_item", "item", prov=[(2, box)]), element(8, "code", " "), element(9, "formula", "a^2"), element(10, "table", captions=["#/11", "#/12"], footnotes=["#/13"], grid=[[("H", True)], [("c", False)]]),
        element(11, "caption", " "), element(12, "caption", "Table 1 x"), element(13, "footnote", "note"), element(14, "picture", captions=["#/15"]), element(15, "caption", "Figure 1 y"), element(16, "text", "hidden", layer="furniture"), element(17, "text", None),
    ]
    got = map_elements(spark.createDataFrame(rows, ELEMENTS)).orderBy("ord").collect()
    assert [(r.block_id, r.block_type, r.text, r.heading_level) for r in got] == [
        ("block_0", "heading", "Report", 1), ("block_1", "heading", "4.2 Cells", 2), ("block_2", "heading", "Odd", 3), ("block_3", "paragraph", "prose", None), ("block_4", "list_item", "item", None), ("block_5", "formula", "a^2", None),
        ("block_6", "table", None, None), ("block_7", "image", None, None),
    ]
    assert (got[3].page, got[3].bbox.x0, got[3].bbox.y0, got[3].bbox.y1, got[3].bbox.coord_origin, [s.page for s in got[3].layout_spans]) == (1, 1.0, 5.0, 9.0, "BOTTOMLEFT", [1, 2])
    assert got[4].layout_spans == [] and got[4].page == 2 and got[0].page is None
    assert (got[6].table_data.headers, got[6].table_data.body_rows, got[6].table_data.caption) == (["H"], [["c"]], "Table 1 x") and got[7].image.caption == "Figure 1 y"
    assert map_elements(spark.createDataFrame(rows, ELEMENTS), contents_removable=False).where("block_type = 'table'").count() == 2
    assert map_elements(spark.createDataFrame([], ELEMENTS)).count() == 0
