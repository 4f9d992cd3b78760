"""Saved documents: a whole one as tables, and a scan's tables written, read and equal."""

import json

import wirechart
from wirechart.sources import saved


def rows(df):
    return sorted(map(repr, df.collect()))


def test_a_whole_document_becomes_tables(spark, tmp_path):
    call = {"rawUrl": "http://b/x", "method": "GET", "callPattern": "axios", "sourceFile": "a.ts", "line": 4, "confidence": 0.9}
    ends = [{"service": "a", "method": "GET", "path": "/p", "fullPath": "/p", "sourceFile": "a.ts", "outboundCalls": [call, call | {"conditional": True}], "requestBody": {"typeName": "T", "fields": [{"name": "n", "type": "string", "required": True}], "source": "interface"}}, {"method": "PUT", "path": "/q", "outboundCalls": []}]
    document = {"meta": {"schemaVersion": "1.0"}, "codeScanResults": [{"serviceName": "a", "language": {"language": "typescript", "confidence": 0.9}, "endpoints": ends, "dbUsage": [{"name": "t", "dbType": "sql"}]}, {"serviceName": "b"}], "dependencies": [{"from": "a", "to": "b", "detectedVia": "description", "evidence": "e"}], "callChains": [{"rootService": "a", "rootEndpoint": "GET /p", "edges": [{"from": "a:GET /p", "to": "b:GET /x", "fromService": "a", "toService": "b", "confidence": 0.9}]}]}
    (tmp_path / "out.json").write_text(json.dumps(document, indent=2))
    found = saved.tables(saved.read_documents(spark, str(tmp_path / "out.json")))
    assert sorted((r.service, r.language) for r in found["services"].collect()) == [("a", "typescript"), ("b", None)]
    assert sorted((r.ep_seq, r.method, r.request_body and r.request_body.fields[0].name) for r in found["endpoints"].collect()) == [(0, "GET", "n"), (1, "PUT", None)]
    assert sorted((r.ep_seq, r.call_seq, r.conditional) for r in found["calls"].collect()) == [(0, 0, None), (0, 1, True)]
    assert [r.name for r in found["stores"].collect()] == ["t"] and [r.evidence for r in found["dependencies"].collect()] == ["e"] and [r.to_service for r in found["edges"].collect()] == ["b"]
    assert found["hints"].count() == found["messages"].count() == found["libraries"].count() == 0


def test_tables_come_back_equal_in_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(saved, "ROWS", 3)
    root = tmp_path / "shop"
    root.mkdir()
    (root / "package.json").write_text('{"dependencies": {"express": "1"}}')
    (root / "r.router.ts").write_text("".join(f"router.get('/p{i}', async (q, r) => {{\n  await axios.get('http://stock/x{i}');\n}});\n" for i in range(8)) + "".join(f"const A{i}_URL = 'http://s{i}';\nproducer.send({{ topic: 't{i}' }});\n" for i in range(7)) + "export interface T {\n  a: string;\n}\n")
    found = saved.of_scan(wirechart.scan(spark, {"shop": str(root)}))
    saved.save_documents(found, str(tmp_path / "out"))
    back = saved.tables(saved.read_documents(spark, str(tmp_path / "out"), lines=True))
    assert back["endpoints"].count() == 8 and back["calls"].count() == 8 and back["hints"].count() == 7 and back["messages"].count() == 7
    # descriptions of fields, which a scan doesn't have, are part of the saved shape
    for name, table in found.items():
        columns = [c for c in table.columns if c not in ("fields", "request_body", "response_body")]
        assert rows(back[name].select(*columns)) == rows(table.select(*columns)), name
    assert [[tuple(f)[:3] for f in r.fields] for r in back["types"].collect()] == [[("a", "string", True)]]
    assert max(len(json.loads(line)["codeScanResults"][0].get("endpoints", [])) for f in (tmp_path / "out").glob("part*") for line in f.read_text().splitlines() if "codeScanResults" in line) == 3
