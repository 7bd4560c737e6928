import http.server
import json
import threading

from tagweave.sources import adapters


def test_model_replies_and_failures(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200 if body["images"][0] else 500)
            self.end_headers()
            self.wfile.write(json.dumps({"response": " FT-101 "}).encode())

        def do_GET(self):
            self.send_response(200)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    crops = spark.createDataFrame([(0, 1, bytearray(b"x")), (0, 2, bytearray(b""))], "page int, ord bigint, png binary")
    assert sorted((r.ord, r.reply) for r in adapters.model_replies(crops, url, "m", "p", 5).collect()) == [(1, "FT-101"), (2, "")]
    assert adapters.available(url) and not adapters.available("http://127.0.0.1:9/")
    assert adapters.ask("http://127.0.0.1:9/", "m", "p", b"x", 1) == ""
    server.shutdown()


def test_raster_adapters_plan_without_their_libraries(spark):
    from tagweave.sources import raster

    images = spark.createDataFrame([], "page int, png binary, width int, height int")
    shapes = spark.createDataFrame([], "page int, shape_id bigint, bbox struct<x int, y int, w int, h int>")
    assert raster.contours(images).columns[:3] == ["page", "idx", "parent"]
    assert raster.headers(images).columns == ["page", "text"]
    assert raster.raster_segments(images, shapes).collect() == [] and raster.label_reads(images, shapes).columns == ["page", "ord", "attempt", "raw_text"]
