"""Entry point of python -m tsubame."""

from tsubame.cli import main

raise SystemExit(main())
