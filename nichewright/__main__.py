import sys

from nichewright.cli import main

sys.exit(main())
