-- Share of one- and two-star reviews per category.
WITH order_categories AS (
  SELECT DISTINCT i.order_id, coalesce(p.category, 'unknown') AS category
  FROM star_items AS i LEFT JOIN star_products AS p USING (product_id)
)
SELECT c.category, count(*) AS total_reviews,
       round(avg(if(r.review_score <= 2, 1D, 0D)), 4) AS negative_review_rate
FROM star_reviews AS r JOIN order_categories AS c USING (order_id)
GROUP BY c.category
HAVING count(*) >= :category_min
ORDER BY negative_review_rate DESC, c.category
