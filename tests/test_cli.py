import json

from stockpot.__main__ import main


def test_crawl_index_query(spark, tmp_path, capsys):
    page = '<title>t</title><script type="application/ld+json">{"@type":"Recipe","name":"Bean Stew","recipeIngredient":["1 cup beans"],"totalTime":"PT20M"}</script><a href="https://www.food.com/recipe/b">b</a>'
    rows = [("https://www.food.com/recipe/a", page), ("https://www.food.com/recipe/b", "<title>Plain Bread</title><p>Bake.</p>")]
    spark.createDataFrame(rows, "url string, html string").write.parquet(str(tmp_path / "pages"))
    (tmp_path / "seeds.txt").write_text("# start\nhttps://www.food.com/recipe/a\n")
    main(["crawl", "--seeds", str(tmp_path / "seeds.txt"), "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "out")], spark)
    assert json.loads(capsys.readouterr().out)["visitedCount"] == 2
    main(["index", "--docs", str(tmp_path / "out/docs"), "--out", str(tmp_path / "ix")], spark)
    main(["query", "--index", str(tmp_path / "ix"), "--query", "beens under 30", "--auto-correct"], spark)
    out = json.loads(capsys.readouterr().out)
    assert out["total_hits"] == 1 and out["hits"][0]["title"] == "Bean Stew"
    main(["tables", "--docs", str(tmp_path / "out/docs"), "--out", str(tmp_path / "t"), "--limit", "1"], spark)
    assert json.loads(capsys.readouterr().out) == {"written": 1}
