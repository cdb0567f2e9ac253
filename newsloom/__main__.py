from newsloom.cli import configure_logging, main

if __name__ == "__main__":
    configure_logging()
    raise SystemExit(main())
