"""A page with the index's figures and the same figures as JSON."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from tessera.api import Engine

PAGE = """<!doctype html><title>Index</title><h1>Index</h1><table id=t></table>
<script>async function show(){const s=await (await fetch('/api/stats')).json();
document.getElementById('t').innerHTML=Object.entries(s).map(([k,v])=>`<tr><td>${k}</td><td>${v}</td></tr>`).join('')}
show();setInterval(show,2000)</script>"""


def serve(engine: Engine, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Starts a server in the background: GET /api/stats gives JSON, any other path the page. ``shutdown()`` ends it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            if self.path == "/api/stats":
                body, kind = engine.status().toJSON().first().encode(), "application/json"
            else:
                body, kind = PAGE.encode(), "text/html; charset=utf-8"
            self.send_response(200)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def stats(url: str) -> dict:
    from urllib.request import urlopen

    with urlopen(url + "/api/stats", timeout=60) as f:
        return json.load(f)
