"""The watch loop as a service of the operating system: a systemd user unit, or a launchd agent on macOS."""

from __future__ import annotations

import os
import plistlib
import shlex
import subprocess
import sys
from collections.abc import Callable
from pathlib import Path

NAME = "sessionlake-watch"
LABEL = "org.sessionlake.watch"


def _run(command: list[str]) -> tuple[int, str]:
    done = subprocess.run(command, capture_output=True, text=True, check=False)
    return done.returncode, (done.stdout + done.stderr).strip()


class Service:
    """Installs, removes and asks after the service; ``run`` is what carries out the system's own commands."""

    def __init__(self, command: list[str] | None = None, home: str | None = None, platform: str = sys.platform, run: Callable[[list[str]], tuple[int, str]] = _run):
        self.command = command or [sys.executable, "-m", "sessionlake.cli", "watch"]
        self.mac, self.run = platform == "darwin", run
        home_dir = Path(home or Path.home())
        self.file = home_dir / "Library/LaunchAgents" / f"{LABEL}.plist" if self.mac else home_dir / ".config/systemd/user" / f"{NAME}.service"

    def definition(self) -> bytes:
        if self.mac:
            return plistlib.dumps({"Label": LABEL, "ProgramArguments": self.command, "RunAtLoad": True, "KeepAlive": True})
        return f"""[Unit]
Description=Ingest of new and changed agent sessions

[Service]
ExecStart={shlex.join(self.command)}
Restart=on-failure
RestartSec=30

[Install]
WantedBy=default.target
""".encode()

    def _tell(self, systemd: list[str], launchd: list[str]) -> dict:
        code, said = self.run(["launchctl", *launchd] if self.mac else ["systemctl", "--user", *systemd])
        return {"installed": self.file.exists(), "ok": code == 0, "message": said}

    def install(self) -> dict:
        self.file.parent.mkdir(parents=True, exist_ok=True)
        staged = self.file.with_suffix(".new")
        staged.write_bytes(self.definition())
        os.replace(staged, self.file)
        if not self.mac:
            self.run(["systemctl", "--user", "daemon-reload"])
        return self._tell(["enable", "--now", NAME], ["load", "-w", str(self.file)])

    def uninstall(self) -> dict:
        if not self.file.exists():
            return {"installed": False, "ok": True, "message": "not installed"}
        told = self._tell(["disable", "--now", NAME], ["unload", "-w", str(self.file)])
        self.file.unlink()
        return told | {"installed": False}

    def start(self) -> dict:
        return self._tell(["start", NAME], ["start", LABEL])

    def stop(self) -> dict:
        return self._tell(["stop", NAME], ["stop", LABEL])

    def status(self) -> dict:
        if not self.file.exists():
            return {"installed": False, "ok": False, "message": "not installed"}
        return self._tell(["is-active", NAME], ["list", LABEL])
