"""Where the star schema comes from and where result modules go."""
