"""Where rows come from: tables, files, SQL stores."""
