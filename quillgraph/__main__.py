from quillgraph.cli import main

raise SystemExit(main())
