"""One model server for each executor: a process that starts it, watches it and stops it when no worker holds on to it any more.

A keeper listens at a socket of an abstract name (Linux), so that of two keepers of one name the second ends at once, and
nothing is left behind whoever dies. Workers hold a connection; one that sends a byte gets the server's port, for which
the keeper starts the server again if it ended. Without connections for linger seconds the keeper stops the server and ends.
"""

from __future__ import annotations

import json
import os
import selectors
import socket
import subprocess
import sys
import threading
import time
import urllib.request
from collections import deque

#: Seconds that a server may take to get ready and to stop, and characters of its errors that are shown.
READY, STOP, TAIL = 180, 10, 4000
#: What stands for the port in a server's command.
PORT = "{port}"


class Server:
    """A model server as a child process: with Server(command, health) as s. It is stopped whatever happens inside."""

    def __init__(self, command: list[str], health: str, ready: float = READY, pause: float = 1.0):
        self.command, self.health, self.ready, self.pause = command, health, ready, pause
        self.process: subprocess.Popen | None = None
        self.said: deque[str] = deque(maxlen=TAIL)

    def __enter__(self) -> Server:
        self.process = subprocess.Popen(self.command, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE, text=True, errors="replace")
        # Read all along: a full pipe would stop the server.
        reader = threading.Thread(target=lambda lines: [self.said.extend(line) for line in lines], args=(self.process.stderr,), daemon=True)
        reader.start()
        end = time.monotonic() + self.ready
        while time.monotonic() < end:
            if self.process.poll() is not None:
                reader.join(STOP)
                raise RuntimeError(f"the server ended with {self.process.returncode}: {''.join(self.said)}")
            try:
                with urllib.request.urlopen(self.health, timeout=5) as reply:
                    if reply.status == 200:
                        return self
            except OSError:
                pass
            time.sleep(self.pause)
        self.__exit__()
        raise TimeoutError(f"the server wasn't ready after {self.ready} seconds")

    def __exit__(self, *_) -> None:
        if self.process is None or self.process.poll() is not None:
            return
        self.process.terminate()
        try:
            self.process.wait(STOP)
        except subprocess.TimeoutExpired:
            self.process.kill()
            self.process.wait()


def free_port() -> int:
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def keep(name: str, command: list[str], health: str, ready: float, linger: float) -> None:
    """Keeps the server of a name; returns when it is no longer wanted, or at once where another keeper has the name."""
    listener = socket.socket(socket.AF_UNIX)
    try:
        listener.bind("\0" + name)
    except OSError:
        return
    listener.listen(128)
    chosen = selectors.DefaultSelector()
    chosen.register(listener, selectors.EVENT_READ)
    server, port, held, left = None, 0, set(), time.monotonic()

    def running() -> int:
        nonlocal server, port
        if server is None or server.process.poll() is not None:
            port = free_port()
            server = Server([a.replace(PORT, str(port)) for a in command], f"http://127.0.0.1:{port}{health}", ready, 0.1)
            server.__enter__()
        return port

    try:
        while held or time.monotonic() < left + linger:
            for key, _ in chosen.select(0.2):
                if key.fileobj is listener:
                    link = listener.accept()[0]
                    held.add(link)
                    chosen.register(link, selectors.EVENT_READ)
                    continue
                link = key.fileobj
                try:
                    if not link.recv(1):
                        raise ConnectionError
                    try:
                        said = {"port": running()}
                    except (RuntimeError, OSError) as e:
                        server, said = None, {"error": str(e)}
                    link.sendall(json.dumps(said).encode() + b"\n")
                except OSError:
                    chosen.unregister(link)
                    held.discard(link)
                    link.close()
                    left = time.monotonic()
    finally:
        listener.close()
        if server is not None:
            server.__exit__()


class Held:
    """A worker's hold on the server of its executor; port() starts keeper and server where there are none."""

    def __init__(self, name: str, command: list[str], health: str = "/", ready: float = READY, linger: float = 30.0):
        self.name, self.command, self.health, self.ready, self.linger = name, command, health, ready, linger
        self.link: socket.socket | None = None

    def _linked(self) -> socket.socket:
        """A connection to the keeper; of keepers that several workers start at once one stays."""
        end, began = time.monotonic() + self.ready, False
        while True:
            link = socket.socket(socket.AF_UNIX)
            try:
                link.connect("\0" + self.name)
                return link
            except OSError:
                link.close()
                if time.monotonic() > end:
                    raise
            if not began or began.poll() is not None:
                paths = os.pathsep.join(p for p in sys.path if p)
                given = json.dumps([self.name, self.command, self.health, self.ready, self.linger])
                began = subprocess.Popen([sys.executable, "-m", __name__, given], env={**os.environ, "PYTHONPATH": paths}, stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
            time.sleep(0.1)

    def port(self) -> int:
        for last in (False, True):
            try:
                self.link = self.link or self._linked()
                self.link.settimeout(self.ready + STOP)
                self.link.sendall(b"?")
                line = b""
                while not line.endswith(b"\n"):
                    got = self.link.recv(1 << 16)
                    if not got:
                        raise ConnectionError("the keeper ended")
                    line += got
                break
            except OSError:
                self.close()
                if last:
                    raise
        said = json.loads(line)
        if "error" in said:
            raise RuntimeError(said["error"])
        return said["port"]

    def close(self) -> None:
        if self.link is not None:
            self.link.close()
            self.link = None


if __name__ == "__main__":
    keep(*json.loads(sys.argv[1]))
