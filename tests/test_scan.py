"""A whole scan of two services on disk, through the public names."""

import wirechart


def test_two_services_are_scanned_and_connected(spark, tmp_path):
    shop, stock = tmp_path / "shop", tmp_path / "stock"
    (shop / "src").mkdir(parents=True)
    (stock / "src").mkdir(parents=True)
    (shop / "package.json").write_text('{"name": "shop", "dependencies": {"@nestjs/core": "1"}}')
    (shop / "src" / "shop.controller.ts").write_text("@Controller('shop')\nexport class ShopController {\n  @Get(':id')\n  async one(@Param('id') id: string): Promise<ShopDto> {\n    return axios.get('http://stock/api/stock/1');\n  }\n}\n")
    (shop / "src" / "use.ts").write_text("client.emit('sold', x);\n")
    (stock / "pom.xml").write_text("<a>spring-boot</a>")
    (stock / "src" / "StockController.java").write_text('@RestController\n@RequestMapping("/api/stock")\npublic class StockController {\n  @GetMapping("/1")\n  public StockDto one() {\n    return null;\n  }\n}\n')
    (stock / "openapi.json").write_text('{"openapi": "3.0.0", "info": {"title": "Stock"}, "servers": [{"url": "http://stock.internal"}], "paths": {"/a": {"get": {"summary": "x"}}}}')
    tables = wirechart.scan(spark, {"shop": str(shop), "stock": str(stock)})
    assert {(r.service, r.language, r.framework) for r in tables["services"].collect()} == {("shop", "typescript", "nestjs"), ("stock", "java", "spring-boot")}
    assert {(r.service, r.method, r.full_path) for r in tables["endpoints"].collect()} == {("shop", "GET", "/shop/:id"), ("stock", "GET", "/api/stock/1")}
    assert [(r.service, r.resolved_service, r["rank"]) for r in tables["resolved"].collect()] == [("shop", "stock", "6")]
    assert [(r.from_service, r.to_service, r.to_endpoint) for r in tables["edges"].collect()] == [("shop", "stock", "GET /api/stock/1")]
    assert [(r.topic, r.direction) for r in tables["messages"].collect()] == [("sold", "publish")]
    assert [(r.service, r.endpoint) for r in tables["spec_endpoints"].collect()] == [("stock", "/a")]
    wirechart.save_scan(tables, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "endpoints")).count() == 2
